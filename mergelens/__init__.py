"""Mergelens: pull-request feedback analytics on Spark."""

__version__ = "0.1.0"
