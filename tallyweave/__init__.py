"""Weighted survey analytics on Spark."""
