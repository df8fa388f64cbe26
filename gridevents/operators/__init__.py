"""Operators: DataFrame -> DataFrame, no driver-side data."""
