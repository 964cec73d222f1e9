"""Queries over inventories: DataFrame in, DataFrame out."""
