"""Spark-native corpus analytics: text, index, vector, topic, graph and event operators."""
