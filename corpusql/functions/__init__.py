"""Column -> Column building blocks; every function returns a native expression."""
