"""Column expressions and small batch kernels."""
