"""Plans of gradeloom."""
