"""Distances and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from .text import lookup


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def live_score(distance: Column) -> Column:
    return F.when(distance.isNotNull(), 1 / (1 + F.greatest(distance, F.lit(0.0))))


def calibrated_score(distance: Column) -> Column:
    return F.when(distance.isNotNull(), F.exp(-F.greatest(distance, F.lit(0.0)) / 30))


def rrf(rank: Column, k: int = 60) -> Column:
    """rank counts from 0."""
    return 1 / (F.lit(float(k)) + rank + 1)


def content_key(content: Column, source: Column) -> Column:
    return F.left(F.md5(F.concat(source, F.lit("|"), F.left(F.coalesce(content, F.lit("")), F.lit(200)))), F.lit(16))


def relation_priority(relation: Column, other: int) -> Column:
    return F.coalesce(lookup(V.RELATION_PRIORITY)[relation], F.lit(other))


def graph_score(fulltext: Column, relation: Column, n_sources: Column) -> Column:
    return F.round(0.5 * F.least(fulltext / 4.0, F.lit(1.0)) + 0.3 * relation_priority(relation, 20) / 80.0 + 0.2 * F.least(n_sources / 5.0, F.lit(1.0)), 4)


def evidence_hits(lower: Column, terms: Column) -> Column:
    """How many of the terms a content in lower case holds."""
    return F.size(F.filter(terms, lambda t: F.contains(lower, t)))


def normalized_hits(hits: Column, most: Column) -> Column:
    return F.when(most > 0, F.round(F.least(hits / most, F.lit(1.0)), 4)).otherwise(0.0)
