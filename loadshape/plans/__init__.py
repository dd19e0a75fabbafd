"""Composed plans: the aggregation pipeline and the registered queries."""
