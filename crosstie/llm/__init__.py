"""Operators that prepare training text at corpus scale."""
