"""Operators of gradeloom."""
