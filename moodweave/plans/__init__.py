"""Query plans: the named queries, their SQL oracles and scale helpers."""
