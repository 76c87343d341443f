"""Reusable analytics operators on Spark DataFrames."""
