"""Operators on bounded and unbounded streams."""
