"""Spark-first audit engine over program text held in DataFrames."""
