"""Spark-native analytics over the metadata of SQL transformation projects."""
