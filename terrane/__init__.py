"""Terrane: presence-background analytics on regular grids, written for PySpark."""

__version__ = "0.1.0"
