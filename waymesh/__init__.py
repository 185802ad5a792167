"""Similarity search over typed graphs with places, as Spark plans."""
