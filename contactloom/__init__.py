"""Chromatin-contact analytics on PySpark DataFrames."""
