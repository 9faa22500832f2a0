"""Structured Streaming forms of the operators that work scan by scan."""
