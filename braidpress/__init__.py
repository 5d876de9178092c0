"""Spark-native lossless text compression and corpus preparation."""
