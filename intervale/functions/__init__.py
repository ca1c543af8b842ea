"""Interval-likelihood analytics on Spark."""
