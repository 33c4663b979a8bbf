"""Spark-native analytics for scores and measurements that vary over time and over the entities of a network."""
