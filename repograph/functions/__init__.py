"""Scalar column functions, all built from native Spark expressions."""
