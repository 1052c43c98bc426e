"""Spark-native analytics over genomic site, window, interval and genealogy tables."""
