"""Millrace: dataset preparation as lazy Spark plans."""
