"""Ensemble-field analytics on PySpark DataFrames."""
