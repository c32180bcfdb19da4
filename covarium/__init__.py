"""Covarium: batch analytics over symmetric-positive-definite covariance data on Spark."""

__version__ = "0.1.0"
