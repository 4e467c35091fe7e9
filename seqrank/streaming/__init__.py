"""Incremental forms of the per-gene reductions."""
