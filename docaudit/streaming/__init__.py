"""Streaming forms of the roll-up and of the symbol context."""
