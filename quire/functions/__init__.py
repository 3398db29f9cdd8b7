"""Column functions: each takes columns and returns a column, all of it built-in expressions."""
