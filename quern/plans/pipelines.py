"""Retrieval from query to packed context, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators import answers, context, fusion, gate, graph, ingest, models, search, telemetry, web
from ..session import stored
from ..settings import Settings


def first_hits(chunks: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """Hybrid search, reranked and cleaned: query_id, chunk_id, content, source, tags, distance, rank.

    Written to the shared folder, as all later steps read these few rows of each query; the plan would else be repeated in each.
    """
    return stored(search.cleaned(search.hybrid(chunks, queries), chunks, queries, n), "hits")


def graph_queries(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, terms: of the query, and of the tags and prominent words of its hits."""
    extra = F.concat(F.coalesce("tags", F.array().cast("array<string>")), X.context_terms(F.col("content")))
    found = hits.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", extra.alias("e")))), lambda x: x.e)).alias("extra"))
    rows = queries.join(found, "query_id", "left")
    return rows.select("query_id", X.graph_terms(F.col("query"), F.coalesce("extra", F.array().cast("array<string>"))).alias("terms"))


def evidence_hits(chunks: DataFrame, queries: DataFrame, hits: DataFrame, relations: DataFrame, n: int, most: int | None = 500) -> DataFrame:
    """Chunks of documents that the relations come from and the hits don't; of a query's chunks the first ``most`` are looked at, or all if None."""
    said = relations.withColumn("said", F.concat_ws(" ", "source", "relation", "target"))
    said = said.groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "said"))), lambda x: x.said), 1, 12).alias("said"))
    terms = queries.join(said, "query_id", "left").select("query_id", X.evidence_terms(F.concat_ws(" ", F.array("query"), F.coalesce("said", F.array().cast("array<string>")))).alias("terms"))
    wanted = relations.select("query_id", F.explode("sources").alias("source")).distinct().join(hits.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
    return search.evidence(chunks, in_scope(wanted, hits).join(terms, "query_id"), hits.select("query_id", "content"), n, most)


def in_scope(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """wanted (query_id, source) of the scopes that the query's hits come from; all where no hit has a source."""
    scopes = hits.where("source <> ''").groupBy("query_id").agg(F.collect_set(X.source_scope(F.col("source"))).alias("scopes"))
    rows = wanted.join(scopes, "query_id", "left").where(F.col("scopes").isNull() | F.array_contains("scopes", X.source_scope(F.col("source"))))
    return rows.drop("scopes")


def _items(hits: DataFrame, relations: DataFrame, proofs: DataFrame) -> DataFrame:
    """query_id, ordinal, type, content, source, tags, score, distance: hits, then relations, then evidence."""
    none, tags = F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    shown = F.concat(F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target"))
    parts = [
        hits.select("query_id", F.lit(0).alias("p"), "rank", F.lit("vector").alias("type"), "content", F.coalesce("source", F.lit("unknown")).alias("source"), "tags", S.live_score(F.col("distance")).alias("score"), "distance"),
        relations.select("query_id", F.lit(1).alias("p"), "rank", F.lit("graph").alias("type"), shown.alias("content"), F.lit("knowledge_graph").alias("source"), F.array(F.lit("graph")).alias("tags"), none.alias("score"), none.alias("distance")),
        proofs.select("query_id", F.lit(2).alias("p"), "rank", F.lit("graph_evidence").alias("type"), "content", F.coalesce("source", F.lit("unknown")).alias("source"), tags.alias("tags"), F.lit(0.55).alias("score"), none.alias("distance")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("p", "rank"))).drop("p")


def hybrid_context(chunks: DataFrame, queries: DataFrame, edges: DataFrame, n_vector: int = 5, n_graph: int = 10, n_evidence: int = 5, budget: int = 12000, rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, decisions): the context of each query, hits first, then relations, then evidence, and the gate's verdict by ``rules`` other than its defaults."""
    hits = first_hits(chunks, queries, max(1, min(n_vector, 10)))
    relations = stored(graph.search(edges, graph_queries(queries, hits), max(0, min(n_graph, 30))), "relations")
    proofs = stored(evidence_hits(chunks, queries, hits, relations, max(0, min(n_evidence, 12))), "evidence")
    packed = context.packed(stored(_items(hits, relations, proofs), "items"), max(2000, min(budget, 50000)))
    decisions, judged = gate.decided(queries, packed, **(rules or {}))
    return judged, decisions


def hybrid_context_fused(chunks: DataFrame, queries: DataFrame, edges: DataFrame, n_vector: int = 5, n_graph: int = 10, n_evidence: int = 5, budget: int = 12000, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same with scored graph search and rank fusion of the three paths.

    ``whole``: all edges of all entities found, and all chunks of the relations' documents, are scored, not only the first of them.
    """
    hits = first_hits(chunks, queries, n_vector)
    relations = stored(graph.scored_search(edges, graph_queries(queries, hits), n_graph, whole), "relations")
    proofs = stored(evidence_hits(chunks, queries, hits, relations, n_evidence, None if whole else 500), "evidence")
    n_terms = F.greatest(F.size(X.evidence_terms(F.col("query"))), F.lit(1))
    items = _items(hits, relations.drop("fulltext"), proofs)
    scored = items.join(relations.select("query_id", F.concat(F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target")).alias("content"), F.col("graph_score").alias("g")), ["query_id", "content"], "left")
    scored = scored.join(proofs.join(queries.select("query_id", "query"), "query_id").select("query_id", "content", F.least(F.col("hits") / n_terms, F.lit(1.0)).alias("e")), ["query_id", "content"], "left")
    path = F.when(F.col("type") == "graph_evidence", "evidence").otherwise(F.col("type"))
    score = F.when(F.col("type") == "vector", S.calibrated_score(F.col("distance"))).when(F.col("type") == "graph", F.col("g")).otherwise(F.col("e"))
    by_path = Window.partitionBy("query_id", "type").orderBy("ordinal")
    candidates = scored.select("query_id", path.alias("path"), (F.row_number().over(by_path) - 1).alias("rank"), "content", "source", "type", score.alias("score"), F.when(F.col("type") == "graph", F.col("content")).alias("traversal"))
    fused = stored(fusion.fused(candidates).withColumnRenamed("fused_rank", "ordinal"), "fused")
    packed = context.packed(fused, budget)
    decisions, judged = gate.decided(queries, packed)
    return judged, decisions


def retrieved(chunks: DataFrame, queries: DataFrame, edges: DataFrame, settings: Settings | None = None, top_k: int | None = None, endpoint: str = "retrieve") -> tuple[DataFrame, DataFrame]:
    """(results, records): what a caller gets for each query, and one record of each query for the telemetry log.

    results: the items that the gate accepts (all of them with the gate switched off), at most ``top_k`` (1 to 20) of a query, with rank.
    records: query_id, endpoint, query (500 characters), instruction, rag_used, the gate's figures, counts of results before and after, types
    (a map of counts) and sources (the first 20 different ones that aren't the graph's).

    Defined cases: a query without items has a record with empty types and sources; without ``settings`` the session's are taken.
    """
    settings = settings or Settings.of(queries.sparkSession)
    most = None if top_k is None else max(1, min(top_k, 20))
    n_vector = settings.n_vector if most is None else min(settings.n_vector, most)
    items, decisions = hybrid_context(chunks, queries, edges, n_vector, settings.n_graph, settings.n_evidence, settings.budget, settings.rules())
    items = stored(items, "judged")
    kept = items.where("accepted") if settings.gate else items
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal")))
    results = kept if most is None else kept.where(F.col("rank") <= most)
    counts = items.groupBy("query_id").agg(F.count_if("accepted").alias("accepted_results"), F.count_if(~F.col("accepted")).alias("rejected_results"))
    types = results.groupBy("query_id", "type").agg(F.count("*").alias("n")).groupBy("query_id")
    types = types.agg(F.sum("n").alias("results_after_gate"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    sources = telemetry.first_sources(results.where("source <> 'knowledge_graph'"))
    rows = queries.select("query_id", F.left("query", F.lit(500)).alias("query")).join(decisions, "query_id")
    for more in (counts, types, sources):
        rows = rows.join(more, "query_id", "left")
    used = F.col("used") if settings.gate else F.lit(True)
    none = F.lit(0).cast("long")
    records = rows.select(
        "query_id",
        F.lit(endpoint).alias("endpoint"),
        "query",
        F.when(used, settings.context).otherwise(settings.no_context).alias("instruction"),
        used.alias("rag_used"),
        F.col("score").alias("relevance_score"),
        F.col("reason").alias("gate_reason"),
        "top_score",
        F.lit(settings.threshold).alias("threshold"),
        F.col("overlap").alias("lexical_overlap"),
        F.col("before").alias("results_before_gate"),
        *[F.coalesce(c, none).alias(c) for c in ("accepted_results", "rejected_results", "results_after_gate")],
        F.lit(most).cast("int").alias("top_k"),
        F.lit(settings.gate).alias("gate_enabled"),
        F.coalesce("types", F.create_map().cast("map<string,bigint>")).alias("types"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
    )
    return results, records


def website_import(found: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, generate: models.Generate | None = None, reindex: bool = False, memo: models.Memo | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """(new chunks, chunks that stay, changes of the graph or None, one row of totals) of crawled pages (url, title, text) and stored chunks
    (source, hash, ...). With ``edges`` and ``generate``, pages are also read for relations. An address is one page."""
    docs, kept, totals = web.imported(found, chunks, reindex)
    docs = stored(docs, "site")
    fresh, counts = ingest.ingested(docs, kept)
    none = F.lit(0).cast("long")
    sums = lambda rows, **named: rows.agg(*[F.coalesce(F.sum(c), none).alias(n) for n, c in named.items()])
    totals = totals.crossJoin(sums(counts, **{c: c for c in ("chunks", "valid", "inserted", "duplicates", "invalid")}))
    changes, graphs = None, ("graph_valid", "graph_created", "graph_existing")
    if edges is None or generate is None:
        return fresh, kept, changes, totals.withColumns({c: none for c in graphs})
    texts = docs.withColumn("doc_id", F.col("source"))
    changes, counters = graph.change_set(models.with_triples(models.sampled(texts), generate, memo), edges, whole=texts)
    return fresh, kept, changes, totals.crossJoin(sums(counters, graph_valid="n_valid", graph_created="n_created", graph_existing="n_existing"))


def answer_context(chunks: DataFrame, queries: DataFrame, n: int = 6, budget: int = 4000) -> DataFrame:
    """The shorter context that an answer is made from: hits that fit, until the first that doesn't."""
    hits = first_hits(chunks, queries, n).withColumn("ordinal", F.col("rank"))
    return context.prefix(hits, budget)


def variants_of(queries: DataFrame, hints: Column | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """queries with other wordings as rows of their own, unique without case. ``embed`` makes a wording's vector; without it the other
    wordings take the query's."""
    lists = F.concat(F.array("query"), hints) if hints is not None else F.array("query")
    wordings = X.unique_without_case(F.filter(F.transform(lists, X.stripped), lambda q: q.isNotNull() & (q != "")))
    rows = queries.select("query_id", F.posexplode(wordings).alias("variant", "query"), *[c for c in queries.columns if c not in ("query_id", "query")])
    return rows if embed is None else rows.withColumn("embedding", F.when(F.col("variant") == 0, F.col("embedding")).otherwise(embed(F.col("query"))))


def variant_search(chunks: DataFrame, queries: DataFrame, n: int = 20, tags: list[str] | None = None, hints: Column | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, query (all wordings), chunk_id, content, ordinal, priority: search of every wording of a query, with the tags and, if there are any, without.

    Each wording's hits are reranked for that wording, with its own vector. Hits of equal content (without case and outer space) count once, at
    the first wording that finds them; the best for operations come first, else in the order found, and the first n stay.
    """
    asked = stored(variants_of(queries, hints, embed).withColumn("own", F.xxhash64("query_id", "variant")), "wordings")
    # A wording is a query of its own; its number is made from the query's, so nothing is numbered over all.
    one = asked.select(F.col("own").alias("query_id"), "query", "embedding")
    found = []
    for turn, tagged in enumerate((tags, None) if tags else (None,)):
        hits = stored(search.hybrid(chunks, one, tags=tagged), "variant-hits")
        found.append(search.reranked(hits, chunks, one).select(F.col("query_id").alias("own"), "chunk_id", "content", "rank", F.lit(turn).alias("turn")))
    rows = reduce(DataFrame.unionByName, found).join(asked.select("own", "query_id", "variant"), "own")
    rows = rows.withColumn("same", F.md5(F.lower(X.stripped(F.col("content")))))
    first = Window.partitionBy("query_id", "same").orderBy("variant", "turn", "rank")
    rows = rows.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("variant", "turn", "rank")))
    whole = asked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "query"))), lambda x: x.query), "\n").alias("query"))
    ranked = answers.prioritized(rows.select("query_id", "chunk_id", "content", "ordinal").join(whole, "query_id"))
    return ranked.where(F.col("priority") <= n).select("query_id", "query", "chunk_id", "content", "ordinal", "priority")


def answer_search(chunks: DataFrame, queries: DataFrame, generate: models.Generate, tags: list[str] | None = None, mode: str = "auto", embed: Callable[[Column], Column] | None = None, memo: models.Memo | None = None) -> DataFrame:
    """query_id, chunk_id, content, mode, rank: variant search of a query, of a model's wording of it and of hints for it; in smart mode the model
    puts the first 20 in order, in fast mode they stay as they are."""
    asked = models.rewritten(queries, generate, memo)
    asked = asked.withColumn("mode", answers.mode(F.col("query"), F.lit(mode)))
    hints = F.concat(F.array("wording"), answers.hints(F.col("query")))
    found = stored(variant_search(chunks, asked.select("query_id", "query", "embedding", "wording"), 20, tags, hints, embed).join(asked.select("query_id", "mode"), "query_id"), "answers")
    smart = found.where("mode = 'smart'").withColumnRenamed("ordinal", "found_at").withColumnRenamed("priority", "ordinal")
    said = models.model_reranked(smart.drop("query"), smart.select("query_id", "query").distinct(), generate, memo=memo)
    fast = found.where("mode = 'fast'").withColumnRenamed("priority", "rank")
    columns = ["query_id", "chunk_id", "content", "mode", "rank"]
    return said.select(*columns).unionByName(fast.select(*columns))
