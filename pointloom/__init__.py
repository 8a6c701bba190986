"""Spark-native analytics for four-column point clouds: scan, bin, sample, quantize, restore, view."""
