"""Spark-native analytics over structured documents."""
