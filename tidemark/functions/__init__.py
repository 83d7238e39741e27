"""Column functions: hash randomness, oscillators, formulas."""
