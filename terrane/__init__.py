"""Terrane: spatial analytics on PySpark."""
