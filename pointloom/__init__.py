"""Spatial sensor analytics expressed as Spark DataFrame programs."""

__version__ = "0.1.0"
