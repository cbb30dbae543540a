"""Numeric kernels without Spark imports."""
