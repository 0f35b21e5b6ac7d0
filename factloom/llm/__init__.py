"""Operators for preparing large text corpora, each a Spark job over DataFrames."""
