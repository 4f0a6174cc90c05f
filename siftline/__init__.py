"""Siftline: a Spark-native engine that finds, stores and reports sensitive strings."""
