"""Column and vector functions."""
