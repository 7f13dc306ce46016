"""Sources of gradeloom."""
