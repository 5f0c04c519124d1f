"""Structured log, trace and metric analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
