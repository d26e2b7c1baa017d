"""Registered queries and, where SQL can say the same, their oracle text."""
