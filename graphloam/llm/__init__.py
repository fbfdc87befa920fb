"""Operators that prepare training text for language models. Nothing outside this package imports it."""
