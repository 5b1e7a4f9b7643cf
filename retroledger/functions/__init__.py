"""Column functions: value encoding, canonical text, redaction."""
