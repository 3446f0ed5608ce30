"""Spark-native analytics over private text: detection, substitution, gating and disclosure metrics."""
