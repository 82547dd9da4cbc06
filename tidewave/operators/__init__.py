"""Distributed operators: functions from DataFrames to DataFrames."""
