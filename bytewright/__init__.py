"""Byte-sequence analytics, compression modelling and archives as Spark DataFrames."""
