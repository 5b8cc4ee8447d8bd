"""Column functions of the fact layer."""
