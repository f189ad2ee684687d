"""Loomery: a PySpark-native engine that turns declared records into training batches."""
