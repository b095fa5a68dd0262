"""Similarity clustering on Spark: distances as a relation of pairs, clusterings of it, and scores of clusterings."""
