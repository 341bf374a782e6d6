"""Cairn: a Spark-native engine for memory, retrieval and corpus workloads."""
