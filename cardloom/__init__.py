"""Spark jobs over payment-card, spending and engagement tables."""
