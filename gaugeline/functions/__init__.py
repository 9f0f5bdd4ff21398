"""Column functions: text templates, identities, attributes, model prices."""
