"""Vector arithmetic on arrays of doubles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """``a`` over (its length + 1e-12)."""
    return F.transform(F.array(norm(a) + F.lit(1e-12)), lambda n: F.transform(a, lambda x: x / n))[0]


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def mean_vector(v: Column) -> Column:
    """The mean of a group's vectors; partial sums meet, not the vectors."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def sum_vector(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(v)))
