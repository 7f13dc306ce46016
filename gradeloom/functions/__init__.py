"""Functions of gradeloom."""
