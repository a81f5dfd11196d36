"""Operators that prepare training text from event contents; nothing else in the library imports them."""
