"""Operators: functions from DataFrames to DataFrames, or to fitted models."""
