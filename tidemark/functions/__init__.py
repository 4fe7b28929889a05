"""Column expressions: scalar, row-wise and binning."""
