"""Reading and checking of payloads."""
