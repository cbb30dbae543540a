"""Spark-native analytics for gridded spatio-temporal fields and multivariate series."""
