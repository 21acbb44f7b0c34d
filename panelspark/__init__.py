"""panelspark: panel analytics on PySpark DataFrames keyed by (date, entity)."""

__version__ = "0.1.0"
