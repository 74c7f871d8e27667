"""A Spark-native engine for literature-based hypothesis discovery."""
