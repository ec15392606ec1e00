"""Spark-native analytics for gridded geophysical fields and the features in them."""
