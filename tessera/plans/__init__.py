"""Composed plans: fixtures, the query registry and its SQL oracle."""
