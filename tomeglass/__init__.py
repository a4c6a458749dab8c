"""Corpus analytics on Spark: topic browsing, keyword search and vector search over DataFrames."""
