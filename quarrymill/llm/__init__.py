"""Operators that prepare a training corpus; nothing else in the library imports them."""
