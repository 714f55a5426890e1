"""Spark-native freight and commodity analytics: DataFrame operators over a typed edge-event table."""
