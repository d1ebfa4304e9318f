"""Spark-native analytics for financial-control data."""
