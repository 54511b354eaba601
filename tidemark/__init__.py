"""Spark-native analytics over bitemporal time series and text corpora."""
