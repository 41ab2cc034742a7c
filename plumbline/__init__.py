"""Structural code analytics on Spark: typed fact tables, detectors, graph and robust-statistics kernels."""
