"""Vector and multi-vector measures as expressions; NULL where lengths differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    value = F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), value)


def vector_dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def vector_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def vector_manhattan(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def vector_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0.0 with a zero vector."""
    size = F.sqrt(_fold(a, a, lambda x, y: x * y)) * F.sqrt(_fold(b, b, lambda x, y: x * y))
    dot = vector_dot(a, b)
    return F.when(dot.isNotNull(), F.when(size > 0, dot / size).otherwise(F.lit(0.0)))


def maxsim_score(doc: Column, query: Column) -> Column:
    """Sum over the query's rows of the greatest dot product with a row of the document."""
    best = lambda q: F.array_max(F.transform(doc, lambda d: vector_dot(d, q)))
    score = F.aggregate(F.transform(query, best), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(doc) > 0) & (F.size(query) > 0), score)


MEASURES = {"vector_distance": vector_distance, "vector_similarity": vector_similarity, "vector_dot": vector_dot, "vector_manhattan": vector_manhattan}
