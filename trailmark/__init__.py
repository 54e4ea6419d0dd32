"""Trailmark: sensor-stream and trajectory analytics on Spark DataFrames."""
