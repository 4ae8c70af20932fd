"""Queries by family; ``catalog`` gathers them."""
