"""Column functions. All are compositions of built-in expressions."""
