"""Retail transaction analytics and data preparation on Spark."""
