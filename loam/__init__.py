"""Spark-native hybrid retrieval, graph, temporal and corpus operators over DataFrames."""
