"""Scenario-based financial time-series analytics on Spark."""
