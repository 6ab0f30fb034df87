"""Operators on DataFrames of boxes, detections, tracks, labels and runs."""
