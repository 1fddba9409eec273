"""Vector expressions over ARRAY<FLOAT>, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if a vector is null or the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length 1, in double precision; an all-zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for all-zero vectors."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def sound(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector can be scored: not null or empty, finite numbers only, ``dim`` of them if given, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    right = F.size(vector) == dim if dim else F.size(vector) > 0
    return F.coalesce(right & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def split_vector(vector: Column, parts: int) -> Column:
    """The vector as ``parts`` consecutive vectors of equal length (multi-vector form)."""
    step = (F.size(vector) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(vector, i * step + 1, step))


def maxsim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query vector the best cosine among the document's vectors, summed."""
    return maxsim_of_units(F.transform(query, unit), F.transform(doc, unit))


def maxsim_of_units(query: Column, doc: Column) -> Column:
    """``maxsim`` of vectors that have unit length already."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    best = F.transform(query, lambda x: F.array_max(F.transform(doc, lambda y: product(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
