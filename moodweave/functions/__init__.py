"""Column-expression helpers (scalar functions, no Python UDFs)."""
