"""Column functions and small formulas."""
