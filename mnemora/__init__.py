"""Spark-native agent-memory analytics: DataFrame in, DataFrame out."""
