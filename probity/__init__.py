"""Responsible-AI audit operators on Spark DataFrames."""
