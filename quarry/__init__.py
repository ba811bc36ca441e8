"""Spark-first analytics over long business documents and the numbers around them."""
