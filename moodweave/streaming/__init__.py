"""Streaming entry points (the per-turn operators are stateless and run per micro-batch)."""
