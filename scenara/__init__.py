"""Scenario analytics on Spark DataFrames."""
