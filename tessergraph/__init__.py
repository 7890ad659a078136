"""A PySpark-native knowledge-graph retrieval engine."""
