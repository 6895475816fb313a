"""Calibrated selective classification on Spark."""

__version__ = "0.1.0"
