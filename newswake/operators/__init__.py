"""Operators: functions from DataFrames to DataFrames. No reads, no writes, no collects."""
