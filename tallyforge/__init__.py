"""Spark-native assessment analytics: pure DataFrame-to-DataFrame operators."""
