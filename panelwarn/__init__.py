"""panelwarn: early-warning analytics on panel data, built on PySpark DataFrames."""

__version__ = "0.1.0"
