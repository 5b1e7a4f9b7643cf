"""Relational operators over change logs: transactions, index, check, resolve, apply, actions."""
