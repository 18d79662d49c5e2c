"""Spark-native analytics over corpora of scanned pages."""
