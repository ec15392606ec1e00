"""Operators on field cubes, time series and features."""
