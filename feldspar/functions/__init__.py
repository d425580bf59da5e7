"""Column functions; none of them is a user function."""
