"""GLM families, Cox windows and special functions as column expressions."""
