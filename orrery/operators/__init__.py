"""Operators: functions from DataFrames and parameters to DataFrames. None of them runs anything by itself."""
