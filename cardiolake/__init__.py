"""Contactless vital-sign analytics expressed as Spark DataFrames."""
