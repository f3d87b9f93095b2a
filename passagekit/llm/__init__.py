"""Operators for the preparation of training text. Nothing outside imports this."""
