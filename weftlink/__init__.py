"""Spark-native record linkage: retrieval, features, scoring, routing, evaluation."""
