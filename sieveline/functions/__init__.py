"""Column functions and exact order statistics."""
