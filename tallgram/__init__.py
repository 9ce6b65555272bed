"""Spark-native summaries of tall matrices held as DataFrames."""
