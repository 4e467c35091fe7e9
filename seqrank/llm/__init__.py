"""Operators for training-data pipelines; each module is one of them. ``catalog`` names their queries."""
