"""Operators on event and counter tables."""
