"""Annotation, detection and track analytics on Spark DataFrames."""
