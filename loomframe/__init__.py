"""Spark-native analytics: decision-support queries, sequences, ordered maps, graphs and text on DataFrames."""
