"""Incident analytics over application logs, expressed as Spark DataFrames."""
