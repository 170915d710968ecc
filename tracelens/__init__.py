"""Trace analytics on Spark: call trees, run statistics, outlier models, collections."""
