"""Spark-native telemetry diagnosis and evaluation engine."""
