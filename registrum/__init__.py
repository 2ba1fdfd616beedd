"""Spark-native analytics over stored public planning-register payloads."""
