"""Column functions with explicit null, rounding and tie rules."""
