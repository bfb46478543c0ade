"""Heliograph: property-graph, vector, text, temporal and time-series analytics on Spark."""
