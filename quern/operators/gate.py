"""The relevance gate: is what was retrieved for a query usable?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import scores as S
from ..functions import text as X
from ..session import stored

ITEM = {
    "query_id": "long", "ordinal": "int", "type": "string", "content": "string", "source": "string", "tags": "array<string>", "score": "double",
    "distance": "double", "fused_score": "double", "graph_score": "double", "source_type": "string", "collection": "string", "flags": "array<string>",
}


def with_columns(items: DataFrame) -> DataFrame:
    """items with all columns of ITEM; null where absent."""
    return items.select(*[(F.col(c) if c in items.columns else F.lit(None)).cast(kind).alias(c) for c, kind in ITEM.items()])


def item_scores(items: DataFrame, live: bool = False) -> DataFrame:
    """items with s, the score in 0..1 less the penalty of quality flags. ``live``: distances count as 1 / (1 + d)."""
    unit = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(c, F.lit(1.0))))
    far = S.live_score(F.col("distance")) if live else S.calibrated_score(F.col("distance"))
    plain = F.coalesce(unit(F.col("score")), far, F.when(F.col("type") == "graph_evidence", 0.55).when(F.col("type") == "vector", 0.35).otherwise(0.0))
    raw = F.when(F.col("fused_score").isNotNull(), unit(F.col("fused_score"))).when(F.col("type") == "graph", F.coalesce(unit(F.col("graph_score")), F.lit(0.15))).otherwise(plain)
    return items.withColumn("s", F.greatest(F.lit(0.0), raw - X.flag_penalty(F.col("flags"), 0.20, 0.25, 0.05)))


def decided(queries: DataFrame, items: DataFrame, threshold: float = 0.45, least_overlap: float = 0.10, least_results: int = 1, need_evidence: bool = True, live: bool = False) -> tuple[DataFrame, DataFrame]:
    """(decisions, items with accepted). queries: query_id, query; items: columns of ITEM, those absent as null.

    One aggregate by query and one join back; the corpus text of a query is never put together: a term is in it if it is in one
    of its items, so overlap is counted over the terms that any item holds.
    """
    asked = queries.select("query_id", "query", F.transform(X.gate_terms(F.col("query")), X.variants).alias("terms"))
    rows = item_scores(with_columns(items), live).join(asked, "query_id")
    text = F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("source", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    is_text = F.col("type").isin("vector", "graph_evidence")
    found = F.when(is_text, F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: F.exists(F.get("terms", i), lambda v: F.contains(F.col("text"), v)) & (F.size("terms") > 0) & (i >= 0)))
    rows = rows.withColumn("text", text).withColumn("found", F.coalesce(found, F.array().cast("array<int>")))
    rows = rows.withColumn("own", F.when(F.size("terms") > 0, F.size("found") / F.size("terms")).otherwise(0.0))
    rows = rows.withColumn("graph_ok", (F.col("type") == "graph") & F.col("fused_score").isNotNull() & (F.col("s") >= threshold))
    current = F.exists(F.concat(F.array(F.lower("source_type"), F.lower("collection")), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))), lambda x: F.coalesce(x.isin(*V.CURRENT_SOURCES), F.lit(False)))
    # A few dozen rows of each query, which the decision, the items and their counts all read.
    rows = stored(rows.withColumn("is_current", current), "gate")
    pool = is_text | F.col("graph_ok")
    strong = max(0.75, least_overlap)
    sums = rows.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.max("s").alias("top_score"),
        F.max("own").alias("own"),
        F.size(F.array_distinct(F.flatten(F.collect_set("found")))).alias("hit"),
        F.count_if(pool & ((F.col("s") >= threshold) | (F.col("own") >= strong))).alias("supported"),
        F.count_if(pool).alias("pool"),
        F.count_if(is_text).alias("texts"),
        F.count_if(F.col("type") == "graph").alias("graphs"),
        F.bool_or(F.col("fused_score").isNotNull()).alias("fusion"),
        F.bool_or("is_current").alias("current"),
    )
    d = asked.join(sums, "query_id", "left").na.fill({"n": 0, "own": 0.0, "hit": 0, "supported": 0, "pool": 0, "texts": 0, "graphs": 0, "fusion": False, "current": False})
    d = d.withColumn("overlap", F.when(F.size("terms") > 0, F.col("hit") / F.size("terms")).otherwise(0.0))
    final = 0.35 * F.coalesce("top_score", F.lit(0.0)) + 0.25 * F.col("overlap") + 0.25 * F.col("own") + 0.15 * F.least(F.col("supported") / max(least_results, 1), F.lit(1.0))
    d = d.withColumn("score", F.round(final, 4))
    override = F.col("fusion") & F.coalesce(F.col("top_score") >= threshold, F.lit(False)) & (F.col("pool") > 0)
    few, weak = (F.col("supported") < least_results) & (F.col("overlap") < 0.70), (F.col("score") < threshold) & (F.col("overlap") < 0.70)
    alone = (F.col("graphs") > 0) & F.lit(need_evidence) & (F.col("texts") == 0) & ~(F.col("fusion") & (F.col("pool") > 0))
    reason = (
        F.when(X.is_temporal(F.col("query")) & ~F.col("current"), "current_query_without_current_source")
        .when(F.col("n") == 0, "empty_results")
        .when(F.col("pool") == 0, "graph_only_without_evidence")
        .when(few, F.when(override, "relevant").otherwise("not_enough_relevant_results"))
        .when((F.col("overlap") < least_overlap) & ~F.col("fusion"), "low_lexical_overlap")
        .when(weak, F.when(override, "relevant").otherwise("low_relevance"))
        .when(alone, "graph_only_without_evidence")
        .otherwise("relevant")
    )
    d = d.withColumn("reason", reason).withColumn("used", F.col("reason") == "relevant")
    judged = rows.drop("query", "terms", "text", "found", "is_current").join(d.select("query_id", "used", "fusion", "texts"), "query_id")
    with_text = F.lit(not need_evidence) | (F.col("texts") > 0)
    accepted = F.col("used") & ((F.col("type") != "graph") | with_text | (F.col("fusion") & (F.col("s") >= threshold)))
    judged = judged.withColumn("accepted", accepted).drop("used", "fusion", "texts", "graph_ok")
    counts = judged.groupBy("query_id").agg(F.count_if("accepted").alias("after"))
    d = d.join(counts, "query_id", "left").select("query_id", "used", "score", "reason", F.round("top_score", 6).alias("top_score"), F.round("overlap", 4).alias("overlap"), F.col("n").cast("long").alias("before"), F.coalesce("after", F.lit(0)).cast("long").alias("after"))
    return d, judged
