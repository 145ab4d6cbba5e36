"""Column-level helpers: labels, guarded arithmetic, dates."""
