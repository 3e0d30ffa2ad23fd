"""Operators over node and edge tables: DataFrame in, DataFrame out."""
