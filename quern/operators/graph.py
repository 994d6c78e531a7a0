"""The knowledge graph as an edge table: source, relation, target, sources (array of document names)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import scores as S
from ..functions import text as X
from ..session import stored
from . import anchors
from .search import in_blocks, in_place

EDGE = ("source", "relation", "target")
COUNTERS = ("n_valid", "n_unique", "n_created", "n_existing", "n_skipped")


def set_union(arrays: str) -> Column:
    """The distinct elements of all arrays of a group, in order of value, so that the result doesn't depend on the order of rows."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(arrays))))


def upserted(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges after merging triples (source, relation, target, document): created says whether an edge is new."""
    new = triples.groupBy(*EDGE).agg(F.collect_set(F.nullif(F.trim("document"), F.lit(""))).alias("sources")).withColumn("old", F.lit(0))
    old = edges.select(*EDGE, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.lit(1).alias("old"))
    rows = old.unionByName(new).groupBy(*EDGE).agg(set_union("sources").alias("sources"), (F.max("old") == 0).alias("created"))
    return rows.withColumn("source_count", F.size("sources"))


def n_sources() -> Column:
    return F.coalesce(F.size("sources"), F.lit(0))


def with_sources(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (few, of every query) with their edges' sources, which are joined last, as they are long, and of those edges only."""
    rows = stored(rows, "relations")
    named = edges.select(*EDGE, F.coalesce("sources", F.array().cast("array<string>")).alias("sources")).join(in_place(rows.select(*EDGE).distinct()), list(EDGE), "left_semi")
    return named.join(in_place(rows), list(EDGE))


def by_terms(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``search`` finds for queries (query_id, terms), which it is only asked once for each different list of terms (without case).

    Searches by terms look at nothing else of a query, so equal lists have equal results: the work grows with the different lists, and
    queries only with what is handed back to them.
    """
    lower = queries.select("query_id", F.transform("terms", lambda t: F.lower(t)).alias("terms")).where("terms is not null")
    asked = stored(lower.select("query_id", F.sha2(F.to_json("terms"), 256).alias("__terms"), "terms"), "asked")
    found = stored(search(asked.select(F.col("__terms").alias("query_id"), "terms").dropDuplicates(["query_id"])), "found").withColumnRenamed("query_id", "__terms")
    return asked.select("query_id", "__terms").join(in_place(found), "__terms").drop("__terms")


def matched(edges: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """query_id, edge, n (of its sources), score of edges of allowed relations with a term in an end: the ``most`` best of each query by score,
    n and edge are among them. queries: query_id, terms.

    Names are far fewer than edges: each different name is compared with the queries once, and what was found is joined to the edges by name.
    All edges that a query finds by one name alone count the same, so only the first ``most`` of a name can be among its best; those of
    which it finds both ends are all looked at.
    """
    allowed = edges.where(F.col("relation").isin(*V.RELATION_PRIORITY)).select(*EDGE, n_sources().alias("n"))
    names = allowed.select(F.col("source").alias("name")).union(allowed.select("target")).distinct()
    asked = queries.select("query_id", F.transform("terms", lambda t: F.lower(t)).alias("terms"))
    rows = in_blocks(names.select("name", F.lower("name").alias("lower")), asked, "terms")
    points = F.aggregate("terms", F.lit(0), lambda a, t: a + 10 * (F.col("lower") == t).cast("int") + 2 * F.contains("lower", t).cast("int"))
    hits = stored(rows.select("query_id", "name", points.alias("points")).where("points > 0"), "names")
    said = in_place(hits.select("name").distinct())
    # An edge that is listed several times counts as often.
    near = {end: allowed.join(said, F.col(end) == F.col("name"), "left_semi").groupBy(*EDGE).agg(F.max("n").alias("n"), F.count("*").cast("int").alias("times")) for end in ("source", "target")}
    found = []
    for end, rows in near.items():
        order = Window.partitionBy(end).orderBy(F.col("times").desc(), F.col("n").desc(), *EDGE)
        first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
        found.append(first.join(in_place(hits), F.col(end) == F.col("name")).select("query_id", *EDGE, "n", (F.col("times") * F.col("points")).alias("score")))
    both = near["source"].join(said, F.col("target") == F.col("name"), "left_semi").join(in_place(hits), F.col("source") == F.col("name")).drop("name")
    other = in_place(hits.select("query_id", F.col("name").alias("target"), F.col("points").alias("more")))
    found.append(both.join(other, ["query_id", "target"]).select("query_id", *EDGE, "n", (F.col("times") * (F.col("points") + F.col("more"))).alias("score")))
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    # An edge found by both ends is there with the points of both.
    return rows.groupBy("query_id", *EDGE).agg(F.max("n").alias("n"), F.max("score").cast("int").alias("score"))


def best_of_pairs(rows: DataFrame, most: int, cap: int | None = None) -> DataFrame:
    """Of each query the best edge of each pair of ends (without case), then the ``most`` best: by score, relation priority, number of sources."""
    size = F.col("n")
    tie = [F.col(c) for c in EDGE]
    if cap:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), size.desc(), *tie))).where(F.col("r") <= cap).drop("r")
    rank = [F.col("score").desc(), S.relation_priority(F.col("relation"), 0).desc(), F.least(size, F.lit(10)).desc(), *tie]
    rows = rows.where((size > 0) & (F.col("source") != "") & (F.col("target") != ""))
    pair = Window.partitionBy("query_id", F.lower("source"), F.lower("target")).orderBy(*rank)
    rows = rows.withColumn("r", F.row_number().over(pair)).where("r = 1").drop("r")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*rank))).where(F.col("rank") <= most)


def search(edges: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    cap = max(20 * n, 100)
    return with_sources(by_terms(queries, lambda asked: best_of_pairs(matched(edges, asked, cap), n, cap).drop("n")), edges)


def bm25(names: DataFrame, queries: DataFrame, n: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, name, score, rank: BM25 over the words of names (name). queries: query_id, terms."""
    return by_terms(queries, lambda asked: _bm25(names, asked, n, k1, b))


def _bm25(names: DataFrame, queries: DataFrame, n: int | None = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    words = lambda c: F.array_compact(F.split(F.lower(c), "[^a-z0-9]+"))
    tokens = names.select("name").distinct().select("name", F.filter(words(F.col("name")), lambda w: w != "").alias("words"))
    posts = tokens.select("name", F.size("words").alias("len"), F.explode("words").alias("word")).groupBy("name", "len", "word").agg(F.count("*").alias("tf"))
    stats = tokens.agg(F.count("*").alias("docs"), F.avg(F.size("words")).alias("avg_len"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("terms", words)))).alias("word")).where("word <> ''")
    # Only words that are asked for are counted and joined.
    posts = posts.join(in_place(asked.select("word").distinct()), "word", "left_semi")
    seen = posts.groupBy("word").agg(F.count("*").alias("df"))
    rows = posts.join(asked, "word").join(seen, "word").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    rows = rows.groupBy("query_id", "name").agg(F.round(F.sum(part), 6).alias("score"))
    if n is None:
        return rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name"))).where(F.col("rank") <= n)


def scored_search(edges: DataFrame, queries: DataFrame, n: int = 10, whole: bool = False) -> DataFrame:
    """Edges one hop from the entities that BM25 finds, by graph score; the best of each pair of ends.

    The edges that are scored are the first 6 n of the 20 best entities, or with ``whole`` all of all entities that hold a word.
    """
    return with_sources(by_terms(queries, lambda asked: _scored(edges, asked, n, whole)), edges)


def _scored(edges: DataFrame, queries: DataFrame, n: int, whole: bool) -> DataFrame:
    names = edges.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name")))
    found = stored(_bm25(names, queries, None if whole else 20).select("query_id", "name", F.col("score").alias("fulltext")), "entities")
    allowed = edges.where(F.col("relation").isin(*V.RELATION_PRIORITY)).select(*EDGE, n_sources().alias("n"))
    ends = allowed.withColumn("name", F.col("source")).unionByName(allowed.where("source <> target").withColumn("name", F.col("target")))
    near = ends.join(in_place(found.select("name").distinct()), "name", "left_semi")
    first = lambda rows, most, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by[0]).orderBy(*by[1]))).where(F.col("r") <= most).drop("r")
    if whole:
        # A name's edges have its points in common, so that what else counts ranks them: only the best edges of its n best pairs of ends can stay.
        own = [S.graph_score(F.lit(0.0), F.col("relation"), F.col("n")).desc(), *[F.col(c) for c in EDGE]]
        near = first(first(near, 1, ("name", F.lower("source"), F.lower("target")), own), n, ("name",), own)
    else:
        # An edge is among a query's first 6 n only if it is among the first 6 n of the name that gives it its score.
        near = first(near, 6 * n, ("name",), EDGE)
    rows = near.join(in_place(found), "name").groupBy("query_id", *EDGE).agg(F.max("fulltext").alias("fulltext"), F.max("n").alias("n"))
    if not whole:
        rows = first(rows, 6 * n, ("query_id",), (F.col("fulltext").desc(), *EDGE))
    rows = rows.withColumn("graph_score", S.graph_score(F.col("fulltext"), F.col("relation"), F.col("n")))
    order = [F.col("graph_score").desc(), *[F.col(c) for c in EDGE]]
    pair = Window.partitionBy("query_id", F.lower("source"), F.lower("target")).orderBy(*order)
    rows = rows.withColumn("r", F.row_number().over(pair)).where("r = 1").drop("r")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n).drop("n")


def fallback_search(edges: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """Search by terms with a graph_score made from its points, for where names can't be ranked: ten points a term count as the best rank."""
    rows = search(edges, queries, n).join(in_place(queries.select("query_id", F.greatest(F.size("terms"), F.lit(1)).alias("asked"))), "query_id")
    fulltext = F.least(F.col("score") / (10.0 * F.col("asked")) * 4.0, F.lit(4.0))
    return rows.withColumn("graph_score", S.graph_score(fulltext, F.col("relation"), F.size("sources"))).drop("asked")


def neighbourhood(edges: DataFrame, term: str, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first n edges with term in an end."""
    part = edges.where(F.contains(F.lower("source"), F.lit(term.lower())) | F.contains(F.lower("target"), F.lit(term.lower()))).orderBy(*EDGE).limit(n)
    return part.select(F.col("source").alias("name")).union(part.select("target")).distinct(), part


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("source").alias("name")), "name", "left_anti").join(edges.select(F.col("target").alias("name")), "name", "left_anti")


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "relation")


def classified(edges: DataFrame, strict: bool = True) -> DataFrame:
    """edges with their clean parts and action: keep, delete or rewrite."""
    rows = edges.withColumns({"clean_source": X.entity_name(F.col("source")), "clean_target": X.entity_name(F.col("target")), "clean_relation": X.relation_name(F.col("relation"))})
    if not strict:
        rows = rows.withColumn("clean_relation", F.coalesce("clean_relation", "relation"))
    gone = F.col("clean_source").isNull() | F.col("clean_target").isNull() | (F.col("clean_source") == F.col("clean_target")) | F.col("clean_relation").isNull()
    same = (F.col("clean_source") == F.col("source")) & (F.col("clean_target") == F.col("target")) & (F.col("clean_relation") == F.col("relation"))
    return rows.withColumn("action", F.when(gone, "delete").when(same, "keep").otherwise("rewrite"))


def cleaned(edges: DataFrame, strict: bool = True) -> DataFrame:
    """The graph after cleanup: rewritten edges are merged into those that exist."""
    rows = classified(edges, strict).where("action <> 'delete'")
    rows = rows.select(*[F.col(f"clean_{c}").alias(c) for c in EDGE], F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    return rows.groupBy(*EDGE).agg(set_union("sources").alias("sources"))


def conflicts(edges: DataFrame) -> DataFrame:
    """Edges of pairs with several relation types, and which of them wins: by priority, number of sources, shorter type, type."""
    types = Window.partitionBy("source", "target")
    rows = edges.withColumn("types", F.size(F.collect_set("relation").over(types))).where("types > 1")
    rank = types.orderBy(S.relation_priority(F.col("relation"), 0).desc(), F.least(F.size("sources"), F.lit(25)).desc(), F.length("relation"), F.col("relation").desc())
    return rows.withColumn("winner", F.row_number().over(rank) == 1)


def resolved(edges: DataFrame) -> DataFrame:
    """One edge for each pair: the winner, with all sources and the types merged into it."""
    best = F.max_by("relation", F.struct(S.relation_priority(F.col("relation"), 0), F.least(F.size("sources"), F.lit(25)), -F.length("relation"), "relation"))
    rows = edges.groupBy("source", "target").agg(best.alias("relation"), set_union("sources").alias("sources"), F.array_sort(F.collect_set("relation")).alias("merged_types"))
    return rows.withColumn("merged_count", F.size("merged_types"))


def clean_triples(triples: DataFrame) -> DataFrame:
    """Triples with canonical parts; those without, and loops, dropped."""
    rows = triples.select(X.entity_name(F.col("source")).alias("source"), X.relation_name(F.col("relation")).alias("relation"), X.entity_name(F.col("target")).alias("target"), *[c for c in triples.columns if c not in EDGE])
    return rows.dropna(subset=list(EDGE)).where("source <> target")


def _spellings() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for alias, name in V.ENTITY_ALIASES.items():
        out.setdefault(name.lower(), []).append(alias.replace("_", " "))
    return out


def supported(triples: DataFrame, text: str, most: int = 8000) -> DataFrame:
    """Triples of which both ends, or other spellings of them, are in the first ``most`` characters of the text column."""
    lower = F.lower(F.left(text, F.lit(most)))
    named = lambda e: F.contains(lower, F.lower(e)) | F.coalesce(F.exists(X.lookup(_spellings())[F.lower(e)], lambda a: F.contains(lower, a)), F.lit(False))
    return triples.where(named(F.col("source")) & named(F.col("target")))


def cleanup_report(edges: DataFrame, strict: bool = True, samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """(action, n of every action; the first ``samples`` edges of each that isn't kept): what cleaned() would do, without doing it."""
    rows = classified(edges, strict)
    counts = rows.groupBy("action").agg(F.count("*").alias("n"))
    order = Window.partitionBy("action").orderBy(*EDGE)
    some = rows.where("action <> 'keep'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= samples)
    return counts, some.select("action", "nth", *EDGE, *[f"clean_{c}" for c in EDGE])


def cleanup(nodes: DataFrame, edges: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row of totals) after cleanup: the clean edges, and no node (name) without one of them.

    Ends of edges are nodes whether or not they are listed. totals: total, keep, delete, rewrite, isolated_nodes_deleted, and invalid_types,
    how many different relation types aren't allowed as they are written.
    """
    ends = lambda rows: rows.select(F.col("source").alias("name")).unionByName(rows.select(F.col("target").alias("name"))).distinct()
    after = stored(cleaned(edges, strict), "clean-edges")
    left = stored(ends(after), "clean-nodes")
    before = nodes.select("name").unionByName(ends(edges)).where("name is not null").distinct()
    gone = before.join(left, "name", "left_anti").agg(F.count("*").alias("isolated_nodes_deleted"))
    is_a = lambda action: F.count_if(F.col("action") == action).alias(action)
    odd = F.count_distinct(F.when(~F.col("relation").isin(*V.RELATION_PRIORITY), F.col("relation")))
    totals = classified(edges, strict).agg(F.count("*").alias("total"), is_a("keep"), is_a("delete"), is_a("rewrite"), odd.alias("invalid_types"))
    return left, after, totals.crossJoin(gone)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, relation types, nodes without an edge."""
    one = edges.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("types"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(one).crossJoin(isolated(nodes, edges).agg(F.count("*").alias("isolated")))


def extracted(docs: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations to merge: source, relation, target, document; counters by document: valid, rejected) of documents (source, text) and a
    model's triples (document, source, relation, target): clean parts, of which the text tells."""
    named = docs.select(F.col("source").alias("document"), "text")
    clean = clean_triples(triples)
    good = supported(clean.join(named, "document"), "text").drop("text")
    n = triples.groupBy("document").agg(F.count("*").alias("given"))
    valid = good.groupBy("document").agg(F.count("*").alias("valid"))
    counters = n.join(valid, "document", "left").select("document", F.coalesce("valid", F.lit(0)).alias("valid"), (F.col("given") - F.coalesce("valid", F.lit(0))).alias("rejected"))
    return good.select(*EDGE, "document").distinct(), counters


def change_set(docs: DataFrame, edges: DataFrame, most: int = 8000, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, counters) of documents (doc_id, source, text, triples: what a model read in them, null for nothing) against the stored edges.

    ``whole``: the same documents (doc_id, source, text) as they were before triples were joined to them. Anchors are then read from these,
    so that whole texts need no join, and docs may hold only the first ``most`` characters of a text.

    changes: (doc_id, document, source, relation, target, state), a row for each different valid relation of a document, from its anchor or
    its triples; ``created`` at the first document (by doc_id) that states what isn't stored yet, else ``existing``. Clean triples whose
    ends the first ``most`` characters don't hold, and triples that can't be cleaned, are skipped. counters: doc_id, n_valid (repeats
    counted), n_unique, n_created, n_existing, n_skipped of every document.
    """
    whole = docs if whole is None else whole
    # Texts are put in lower case once, before a row becomes many.
    texts = whole.select("doc_id", "source", "text", F.lower(F.coalesce("text", F.lit(""))).alias("__lower"))
    said = lambda e, lower: F.contains(lower, F.lower(e)) | F.coalesce(F.exists(X.lookup(_spellings())[F.lower(e)], lambda a: F.contains(lower, a)), F.lit(False))
    sure = ((F.col("relation") == "is_a") & (F.col("target") == "dokument")) | ((F.col("source") == anchors.LEGAL_ANCHOR) & (F.col("target") == "akt normatywny"))
    own = anchors.relations(texts, keep=("doc_id", "__lower")).where("relation is not null")
    own = own.select("doc_id", "document", *EDGE, (sure | said(F.col("target"), F.col("__lower"))).alias("ok"))
    told = docs.select("doc_id", F.col("source").alias("document"), F.lower(F.left(F.coalesce("text", F.lit("")), F.lit(most))).alias("__text"), F.explode("triples").alias("t"))
    told = told.select("doc_id", "document", "__text", X.entity_name(F.col("t.source")).alias("source"), X.relation_name(F.col("t.relation")).alias("relation"), X.entity_name(F.col("t.target")).alias("target"))
    clean = F.col("source").isNotNull() & F.col("relation").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target"))
    told = told.select("doc_id", "document", *EDGE, F.coalesce(clean & said(F.col("source"), F.col("__text")) & said(F.col("target"), F.col("__text")), F.lit(False)).alias("ok"))
    given = stored(own.unionByName(told), "given")
    valid = given.where("ok").groupBy("doc_id", "document", *EDGE).agg(F.count("*").alias("times"))
    first = valid.groupBy(*EDGE).agg(F.min("doc_id").alias("first"))
    first = first.join(edges.select(*EDGE, F.lit(True).alias("there")).distinct(), list(EDGE), "left")
    new = F.col("there").isNull() & (F.col("doc_id") == F.col("first"))
    changes = stored(valid.join(first, list(EDGE)).select("doc_id", "document", *EDGE, F.when(new, "created").otherwise("existing").alias("state"), "times"), "changes")
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    created = (F.col("state") == "created").cast("long")
    parts = [
        changes.select("doc_id", F.col("times").alias("n_valid"), one.alias("n_unique"), created.alias("n_created"), (1 - created).alias("n_existing"), no.alias("n_skipped")),
        given.where("not ok").select("doc_id", no.alias("n_valid"), no.alias("n_unique"), no.alias("n_created"), no.alias("n_existing"), one.alias("n_skipped")),
        whole.select("doc_id", *[no.alias(c) for c in COUNTERS]),
    ]
    counters = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return changes.drop("times"), counters


# Provenance as rows: (source, relation, target, document), document null where an edge has none. No array grows with an edge.


def provenance(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE, F.explode_outer("sources").alias("document"))


def merged(known: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(provenance, edges with source_count and created) after merging triples into what is known, both (source, relation, target, document).

    Rows are made different by edge and document together, so an edge of very many documents is spread; what is left to count for an edge
    is added up before the shuffle.
    """
    rows = known.select(*EDGE, "document", F.lit(1).alias("old")).unionByName(triples.select(*EDGE, F.nullif(F.trim("document"), F.lit("")).alias("document"), F.lit(0).alias("old")))
    rows = rows.groupBy(*EDGE, "document").agg(F.max("old").alias("old"))
    edges = rows.groupBy(*EDGE).agg(F.count("document").cast("int").alias("source_count"), (F.max("old") == 0).alias("created"))
    return rows.drop("old"), edges


def resolved_pairs(known: DataFrame) -> DataFrame:
    """One row for each pair of ends: the relation that wins, merged_types, merged_count, source_count; as resolved(), from provenance rows."""
    sized = known.groupBy(*EDGE, "document").agg(F.lit(1).alias("one")).groupBy(*EDGE).agg(F.count("document").alias("n"))
    best = F.max_by("relation", F.struct(S.relation_priority(F.col("relation"), 0), F.least("n", F.lit(25)), -F.length("relation"), "relation"))
    # There are a few relation types at most.
    types = sized.groupBy("source", "target").agg(best.alias("relation"), F.array_sort(F.collect_set("relation")).alias("merged_types"))
    documents = known.groupBy("source", "target", "document").agg(F.lit(1).alias("one")).groupBy("source", "target").agg(F.count("document").cast("int").alias("source_count"))
    return types.join(documents, ["source", "target"]).withColumn("merged_count", F.size("merged_types"))
