"""Ranked time-series analytics on Spark."""
