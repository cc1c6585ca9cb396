"""A Spark-native graph, vector and text engine: plain DataFrames in, plain DataFrames out."""
