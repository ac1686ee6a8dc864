"""Spark-native span detection, text hygiene and scoring operators."""
