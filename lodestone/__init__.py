"""Lodestone: a Spark-native document-intelligence engine."""
