"""Column functions: text, formulas, geometry."""
