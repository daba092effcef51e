"""Spark-first operators for time-ordered detector and sensor streams."""
