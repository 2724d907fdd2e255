"""Spark-native signal mapping and overlap."""
