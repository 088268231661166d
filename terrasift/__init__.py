"""Terrasift: data-quality rules for vector geospatial layers, as Spark plans."""

__version__ = "0.1.0"
