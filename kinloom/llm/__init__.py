"""Operators that prepare text for model training, as Spark jobs.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers them over the given tables.
"""
