"""Streaming of gradeloom."""
