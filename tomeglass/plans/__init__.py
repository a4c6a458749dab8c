"""Compositions of operators: the tables derived from the given ones, the pages of a corpus browser, the queries."""
