"""Operators of a large-scale training-data pipeline, each an ordinary Spark job."""
