"""Spark-native analytics over the logs and tables of a self-hosted chat stack."""
