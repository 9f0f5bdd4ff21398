"""Operators from parsed payloads to rows of the stored tables."""
