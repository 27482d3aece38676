"""Composed plans: the batch-scoring flow, cross-validation and the query catalog."""
