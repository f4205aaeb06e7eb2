"""Operators that prepare training text for language models."""
