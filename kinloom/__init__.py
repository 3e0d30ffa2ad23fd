"""Relationship-graph jobs on Spark."""
