"""Registered queries: each operator over the given tables, with the same rows in SQL where SQL can say them."""
