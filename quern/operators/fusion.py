"""Reciprocal rank fusion of retrieval paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

#: Paths in the order in which they are seen, and their weights.
PATHS = {"vector": 0.50, "graph": 0.30, "evidence": 0.20}


def fused(candidates: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each query_id and content key.

    candidates: query_id, path (vector, graph, evidence), rank (from 0), content, source, type, score, traversal. A key's
    scores are the best of each path; its rank fusion sums over all its rows, also when it comes twice in one path.
    """
    weights = weights or PATHS
    no, weight = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, (path, w) in enumerate(weights.items()):
        no, weight = F.when(F.col("path") == path, i).otherwise(no), F.when(F.col("path") == path, F.lit(w)).otherwise(weight)
    rows = candidates.withColumns({"no": no, "w": weight, "key": S.content_key(F.col("content"), F.col("source"))})
    first = F.struct("no", "rank")
    of = lambda path, column: F.when(F.col("path") == path, F.col(column))
    rows = rows.groupBy("query_id", "key").agg(
        *[F.min_by(c, first).alias(c) for c in ("content", "source", "type")],
        F.min_by(F.col("traversal"), F.when(F.col("traversal").isNotNull(), first)).alias("traversal"),
        *[F.max(of(p, "score")).alias(f"{p}_score") for p in weights],
        *[F.min(of(p, "rank")).alias(f"rank_{p}") for p in weights],
        F.sum(F.col("w") * S.rrf(F.col("rank"), k)).alias("rrf"),
        F.transform(F.array_sort(F.collect_set(F.struct("no", "path"))), lambda x: x.path).alias("paths"),
        F.min(first).alias("first"),
    )
    most = sum(weights.values()) / (k + 1)
    pointer = F.contains("content", F.lit("--contains-->")) | F.contains("content", F.lit("--is_a-->"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = F.greatest(zero("vector_score"), zero("graph_score") * F.when(pointer, 0.40).otherwise(0.85), zero("evidence_score") * 0.70)
    score = F.round(F.least(base + 0.15 * F.least(F.col("rrf") / most, F.lit(1.0)), F.lit(1.0)), 4)
    reason = F.when(F.size("paths") >= 2, F.concat(F.lit("multi_path("), F.array_join("paths", "|"), F.lit(")"))).otherwise(F.concat(F.get("paths", F.lit(0)), F.lit("_primary")))
    rows = rows.withColumns({"fused_score": score, "reason": reason})
    order = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), "first")
    return rows.withColumn("fused_rank", F.row_number().over(order)).drop("first")
