"""Spark-native transaction and relay forensics engine."""
