"""Spark-native property-graph and knowledge-graph analytics."""
