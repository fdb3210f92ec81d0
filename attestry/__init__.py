"""Spark-native dataset auditing: provenance, leakage, resampling statistics and corpus operators."""
