"""Rank-stability analytics for item-by-model outcomes, written as Spark jobs."""
