"""Operational-finance data checks, features, scoring and forecasting on PySpark."""
