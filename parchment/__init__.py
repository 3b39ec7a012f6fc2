"""Spark-native document analytics: DataFrames in, DataFrames out."""
