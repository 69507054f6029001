"""Spark-native earthquake forecasting: catalogues in, calibrated cell probabilities out."""
