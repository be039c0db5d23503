"""Tessitura: analytics over ordered signals, annotations and predictions, on Spark."""
