"""Operators on collections and vectors."""
