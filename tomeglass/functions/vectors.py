"""Vector expressions: the two text forms, dimension checks and the distance score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every opening or closing bracket is dropped from a written vector.
BRACKETS = r"[\p{Ps}\p{Pe}]"


def parse_vector(text: Column) -> Column:
    """``[0.1, -2]`` or ``(0.1, -2)`` to an array of floats; empty brackets give an empty array."""
    bare = F.trim(F.regexp_replace(text, BRACKETS, ""))
    empty = F.array().cast("array<float>")
    return F.when(bare == "", empty).otherwise(F.split(bare, ",").cast("array<float>"))


def parse_query_vector(text: Column, dim: int) -> Column:
    """Blank-separated floats. A short vector is filled up with zeros, a long one is an error."""
    values = F.split(F.trim(text), r"\s+").cast("array<float>")
    padded = F.concat(values, F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim) - F.size(values)))
    too_long = F.raise_error(F.concat(F.lit(f"query vector longer than {dim}: "), F.size(values)))
    return F.when(F.size(values) > dim, too_long).otherwise(padded)


def of_dimension(vector: Column, dim: int) -> Column:
    """A stored vector has to have exactly ``dim`` values; ``knn.dim_violations`` lists those that have not."""
    text = F.concat(F.lit(f"stored vector is not of dimension {dim}, see dim_violations: "), F.size(vector))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(text))


def filled_up(vector: Column, dim: int) -> Column:
    """A query vector shorter than ``dim`` is filled up with zeros, a longer one is an error."""
    zeros = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(vector))
    padded = F.concat(vector.cast("array<double>"), zeros)
    too_long = F.raise_error(F.concat(F.lit(f"query vector longer than {dim}: "), F.size(vector)))
    return F.when(F.size(vector) > dim, too_long).otherwise(padded)


def squared_l2(a: Column, b: Column) -> Column:
    def add(total: Column, pair: Column) -> Column:
        return total + pair

    gaps = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(gaps, F.lit(0.0), add)


def score_of(squared: Column) -> Column:
    return 1.0 / (1.0 + squared)


def l2_score(a: Column, b: Column) -> Column:
    return score_of(squared_l2(a, b))
