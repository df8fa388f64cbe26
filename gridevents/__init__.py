"""Spark-native analytics for events on gridded time series.

Every operator is a function from DataFrames to a DataFrame (or from Columns to
a Column), so a query is an ordinary Spark plan: Catalyst optimises it and the
cluster runs it by partition.
"""
