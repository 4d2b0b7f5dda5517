"""Derived inputs, registered queries and their SQL checks."""
