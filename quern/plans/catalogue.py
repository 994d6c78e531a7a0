"""Registered queries of the engine's own operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import scores as S
from ..functions import text as X
from ..operators import anchors, answers, chunking, context, conversations, fusion, gate, graph, ingest, models, search, telemetry, web
from ..session import share_code, stored
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores (one small file) is dealt out; any larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) == 1 and df.rdd.getNumPartitions() < cores else df


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            share_code(spark)
            return f(lambda name: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


# How the driver's tables stand for the engine's: documents are chunks, benchmark items with an id divisible by 50 are queries.


def chunk_texts(t) -> DataFrame:
    """All documents without vectors, for what doesn't look at them."""
    return t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", F.array("lang").alias("tags"), F.concat(F.lit('{"source": "'), F.col("source"), F.lit('", "lang": "'), F.col("lang"), F.lit('"}')).alias("metadata"))


def chunk_table(t) -> DataFrame:
    """All documents; embedding is null where there is no vector. Texts meet vectors once: each step would else shuffle them again."""
    vectors = t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return stored(chunk_texts(t).join(vectors, "chunk_id", "left"), "chunks")


def query_table(t, every: bool = False) -> DataFrame:
    items = t("benchmark").where("true" if every else "item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return items.join(t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def item_table(t) -> DataFrame:
    """All benchmark items as queries; embedding is null where there is no vector: such an item is searched for by its words."""
    items = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return items.join(t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def vector_queries(t) -> DataFrame:
    return t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_chunks(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def edge_table(t) -> DataFrame:
    """nation is_a region; supplier runs_on nation; supplier provides part, from the orders in which it does."""
    nation, region, supplier = t("nation"), t("region"), t("supplier")
    none = F.array().cast("array<string>")
    a = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("source"), F.lit("is_a").alias("relation"), F.col("r_name").alias("target"), none.alias("sources"))
    b = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_name").alias("source"), F.lit("runs_on").alias("relation"), F.col("n_name").alias("target"), F.array(F.concat(F.lit("src"), F.col("s_suppkey") % 20)).alias("sources"))
    return a.unionByName(b)


def triple_table(t) -> DataFrame:
    item, part, supplier = t("lineitem"), t("part"), t("supplier")
    rows = item.join(part, item.l_partkey == part.p_partkey).join(supplier, item.l_suppkey == supplier.s_suppkey)
    kind = F.when(F.col("l_returnflag") == "R", "requires").when(F.col("l_returnflag") == "A", "allows").otherwise("provides")
    return rows.select(F.col("s_name").alias("source"), kind.alias("relation"), F.col("p_name").alias("target"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("document"))


def full_graph(t) -> DataFrame:
    return stored(graph.upserted(edge_table(t), triple_table(t)).select(*graph.EDGE, "sources"), "graph")


EDGES_SQL = """
edges AS (
  SELECT n_name AS source, 'is_a' AS relation, r_name AS target, CAST([] AS VARCHAR[]) AS sources FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'runs_on', n_name, ['src' || (s_suppkey % 20)] FROM supplier JOIN nation ON s_nationkey = n_nationkey),
triples AS (
  SELECT s_name AS source, CASE l_returnflag WHEN 'R' THEN 'requires' WHEN 'A' THEN 'allows' ELSE 'provides' END AS relation, p_name AS target, 'o' || l_orderkey AS document
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
graph AS (
  SELECT source, relation, target, list(DISTINCT d) FILTER (WHERE d IS NOT NULL) AS sources, max(old) = 0 AS created
  FROM (SELECT source, relation, target, unnest(CASE WHEN len(sources) = 0 THEN [NULL] ELSE sources END) AS d, 1 AS old FROM edges
        UNION ALL SELECT source, relation, target, document, 0 FROM triples) GROUP BY ALL)
"""
PRIORITY_SQL = "CASE relation WHEN 'requires' THEN 78 WHEN 'runs_on' THEN 74 WHEN 'is_a' THEN 68 WHEN 'provides' THEN 66 WHEN 'allows' THEN 46 ELSE 0 END"
NORM_SQL = r"regexp_replace(regexp_replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g')"
L2_SQL = "round(sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))), 9)"
TERMS_SQL = r"""
terms AS (
  SELECT query_id, term, min(o) AS o FROM (
    SELECT item_id AS query_id, unnest(list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(trim(w, '.,:;!?()[]{}''"`')))) AS term, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS o
    FROM benchmark WHERE item_id % 50 = 0)
  WHERE len(term) >= 3 AND term NOT IN ('and', 'are', 'czy', 'dla', 'for', 'jak', 'jest', 'kto', 'mowi', 'mówi', 'oraz', 'the', 'with', 'wczoraj') GROUP BY query_id, term),
q AS (SELECT b.item_id AS query_id, b.text AS query, e.embedding AS wanted FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE b.item_id % 50 = 0),
chunks AS (SELECT doc_id AS chunk_id, text AS content, source, lang, '{"source": "' || source || '", "lang": "' || lang || '"}' AS metadata, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
"""
FIRST_TERMS_SQL = "firsts AS (SELECT query_id, term FROM terms QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= 10)"
LEXICAL_SQL = f"""{TERMS_SQL}, {FIRST_TERMS_SQL},
lexical AS (
  SELECT q.query_id, chunk_id, sum((content ILIKE '%' || term || '%')::INT * 2 + (source ILIKE '%' || term || '%')::INT * 4 + (metadata ILIKE '%' || term || '%')::INT) AS lexical_score
  FROM chunks, firsts JOIN q USING (query_id) GROUP BY q.query_id, chunk_id HAVING lexical_score > 0)"""
HYBRID_SQL = f"""{LEXICAL_SQL},
near AS (SELECT query_id, chunk_id, md5(content) AS same, {L2_SQL.format(a="embedding", b="wanted")} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS r FROM chunks, q WHERE embedding IS NOT NULL QUALIFY r <= 25),
said AS (SELECT l.query_id, l.chunk_id, md5(content) AS same, l.lexical_score, {L2_SQL.format(a="embedding", b="wanted")} AS distance, row_number() OVER (PARTITION BY l.query_id ORDER BY l.lexical_score DESC, distance ASC NULLS LAST, l.chunk_id) AS r
  FROM lexical l JOIN chunks USING (chunk_id) JOIN q ON q.query_id = l.query_id QUALIFY r <= 250),
both_paths AS (SELECT query_id, chunk_id, distance, 0 AS lexical_score, 'vector' AS path, 0 AS p, r, same FROM near UNION ALL SELECT query_id, chunk_id, distance, lexical_score, 'lexical', 1, r, same FROM said),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, same ORDER BY p, r) AS seen FROM both_paths) WHERE p = 0 OR seen = 1),
hybrid AS (SELECT query_id, chunk_id, distance, lexical_score, path, row_number() OVER (PARTITION BY query_id ORDER BY p, r) AS ordinal FROM kept)"""
LOW_SQL = r"""CASE WHEN trim({c}) = '' THEN 10 WHEN coalesce(list_sum(list_transform(regexp_extract_all({c}, '[A-Za-z0-9+/=]{{24,}}'), lambda x: len(x))), 0) / greatest(len({c}), 1) > 0.35 THEN 20
  WHEN len(regexp_extract_all({c}, '[A-Za-z]{{3,}}')) < 5 THEN 8 ELSE 0 END"""
RERANK_SQL = f"""{HYBRID_SQL},
counted AS (SELECT h.query_id, h.chunk_id, any_value(h.distance) AS distance, any_value(h.ordinal) AS ordinal, any_value(content) AS content, any_value(c.source) AS source,
    coalesce(sum(8 * contains(c.source, term)::INT + 6 * contains(lang, term)::INT + 4 * contains(lower(content), term)::INT), 0) AS words, coalesce(sum(contains(lower(content), term)::INT), 0) AS hits
  FROM hybrid h JOIN chunks c USING (chunk_id) LEFT JOIN terms t ON t.query_id = h.query_id GROUP BY h.query_id, h.chunk_id),
scored AS (SELECT *, words - least(coalesce(distance, 0), 50) * 0.25 + CASE WHEN hits >= 2 THEN 12 ELSE 0 END - ({LOW_SQL.format(c="content")}) - least(len(content), 3000) / 6000 AS score FROM counted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ordinal) AS rank FROM scored)"""


def every_item(sql: str) -> str:
    """The SQL for all benchmark items as queries."""
    return sql.replace(" WHERE item_id % 50 = 0)", ")").replace(" WHERE b.item_id % 50 = 0)", ")")


def whole_table(sql: str) -> str:
    """The same, items without a vector among them."""
    sql = every_item(sql).replace("benchmark b JOIN embeddings", "benchmark b LEFT JOIN embeddings")
    return sql.replace("WHERE embedding IS NOT NULL QUALIFY", "WHERE embedding IS NOT NULL AND wanted IS NOT NULL QUALIFY")


@query(f"""SELECT query_id, chunk_id, round(distance, 4) AS distance, rank FROM (
  SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {L2_SQL.format(a="a.embedding", b="b.embedding")} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 25""")
def q_vector_topk(t):
    return search.vector_top(vector_chunks(t), vector_queries(t)).withColumn("distance", F.round("distance", 4))


@query(f"""WITH near AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.embedding AS x, b.embedding AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2_SQL.format(a="a.embedding", b="b.embedding")}, b.vec_id) AS ordinal
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY ordinal <= 20),
c AS (SELECT query_id, chunk_id, ordinal, round(list_sum(list_transform(list_zip(x, y), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(x, lambda z: CAST(z AS DOUBLE) ** 2))) * sqrt(list_sum(list_transform(y, lambda z: CAST(z AS DOUBLE) ** 2)))), 12) AS cosine FROM near),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN spread < 0.02 THEN 0 ELSE -cosine END, ordinal) AS rank FROM (SELECT *, max(cosine) OVER w - min(cosine) OVER w AS spread FROM c WINDOW w AS (PARTITION BY query_id)))
SELECT query_id, chunk_id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 6""")
def q_cosine_rerank(t):
    hits = search.top(search.vector_top(vector_chunks(t), vector_queries(t), 20), 20, F.col("rank"), rank="ordinal")
    rows = hits.join(vector_chunks(t).withColumnRenamed("embedding", "b"), "chunk_id").join(search.in_place(vector_queries(t).withColumnRenamed("embedding", "a")), "query_id")
    return search.cosine_reranked(rows).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), "rank")


@query(rf"""WITH n AS (SELECT doc_id, {NORM_SQL} AS c FROM documents)
SELECT doc_id, md5(c) AS content_md5, len(c) >= 20 AND len(regexp_replace(c, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(len(c), 1) <= 0.4 AS valid FROM n""")
def q_normalize_valid(t):
    rows = t("documents").withColumn("c", X.normalized(F.col("text")))
    return rows.select("doc_id", F.md5("c").alias("content_md5"), X.is_valid_chunk(F.col("c")).alias("valid"))


@query(f"SELECT md5(lower({NORM_SQL})) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def q_hash_dedup(t):
    rows = t("documents").select(X.content_hash(X.normalized(F.col("text"))).alias("hash"), "doc_id")
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def q_source_count(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(^|[^\w])#([A-Za-z][A-Za-z0-9_-]*)', 2), lambda x: lower(x)))), ',') AS tags FROM documents""")
def q_tags(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(X.hash_tags(F.col("text"))), ",").alias("tags"))


@query(f"SELECT doc_id, {LOW_SQL.format(c='text')} AS penalty FROM documents")
def q_low_quality(t):
    return t("documents").select("doc_id", X.low_quality(F.col("text")).alias("penalty"))


@query(f"WITH {LEXICAL_SQL} SELECT query_id, chunk_id, CAST(lexical_score AS INT) AS lexical_score FROM lexical")
def q_lexical_score(t):
    return search.lexical_scores(chunk_texts(t), query_table(t))


@query(f"WITH {every_item(LEXICAL_SQL).replace(FIRST_TERMS_SQL, 'firsts AS (SELECT query_id, term FROM terms)')} SELECT query_id, chunk_id, CAST(lexical_score AS INT) AS lexical_score FROM lexical")
def q_lexical_score_all(t):
    """Every benchmark item as a query, with all terms of its text, in one pass over the documents."""
    return search.lexical_scores(chunk_texts(t), query_table(t, every=True), terms=None)


@query(f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, round(distance, 4) AS distance, CAST(lexical_score AS INT) AS lexical_score, path, CAST(ordinal AS INT) AS ordinal FROM hybrid")
def q_hybrid_union(t):
    return search.hybrid(chunk_table(t), query_table(t)).select("query_id", "chunk_id", F.round("distance", 4).alias("distance"), "lexical_score", "path", "ordinal")


@query(f"WITH {every_item(HYBRID_SQL)} SELECT query_id, chunk_id, round(distance, 4) AS distance, CAST(lexical_score AS INT) AS lexical_score, path, CAST(ordinal AS INT) AS ordinal FROM hybrid")
def q_hybrid_union_all(t):
    """Every benchmark item as a query."""
    return search.hybrid(chunk_table(t), query_table(t, every=True)).select("query_id", "chunk_id", F.round("distance", 4).alias("distance"), "lexical_score", "path", "ordinal")


@query(f"WITH {RERANK_SQL} SELECT query_id, chunk_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM ranked")
def q_rerank(t):
    chunks, queries = chunk_table(t), query_table(t)
    return search.reranked(search.hybrid(chunks, queries), chunks, queries).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query(rf"""WITH {RERANK_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(content)) ORDER BY rank) AS seen FROM ranked WHERE len(trim(content)) >= 30)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM s WHERE seen = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""")
def q_dedupe_clean(t):
    return pipelines.first_hits(chunk_table(t), query_table(t), 5).select("query_id", "chunk_id", "rank")


#: Windows of 1,200 characters with 200 in common, cut behind the last space or newline past 0.55 of one; sections begin at level-two headings.
CHUNKS_SQL = r"""
doc AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
w(doc_id, source, t, n, b, e) AS (
  SELECT doc_id, source, t, 0, 0, CASE WHEN len(t) <= 1200 THEN len(t) ELSE {end0} END FROM doc WHERE len(t) > 0
  UNION ALL SELECT doc_id, source, t, n + 1, greatest(e - 200, b + 1), {end} FROM w WHERE e < len(t)),
chunk AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_no, c FROM (SELECT doc_id, source, n, regexp_replace(substr(t, b + 1, e - b), '^\s+|\s+$', '', 'g') AS c FROM w) WHERE len(c) > 0)"""


def _end_sql(at: str) -> str:
    """Where the window from ``at`` ends."""
    piece = f"substr(t, {at} + 1, 1200)"
    # Characters up to the last space or newline, itself included.
    gap = f"(1200 + 1 - least(CASE WHEN contains({piece}, ' ') THEN position(' ' IN reverse({piece})) ELSE 1300 END, CASE WHEN contains({piece}, chr(10)) THEN position(chr(10) IN reverse({piece})) ELSE 1300 END))"
    return f"CASE WHEN {at} + 1200 >= len(t) THEN len(t) WHEN {gap} - 1 > 660 THEN {at} + {gap} ELSE {at} + 1200 END"


CHUNKS_SQL = CHUNKS_SQL.replace("{end0}", _end_sql("0")).replace("{end}", _end_sql("greatest(e - 200, b + 1)"))


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(len(c) AS INT) AS n_chars, md5(c) AS chunk_md5 FROM chunk")
def q_chunks(t):
    return chunking.chunks(t("documents").select("doc_id", "text")).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query(rf"""WITH RECURSIVE {CHUNKS_SQL},
n AS (SELECT source, chunk_no, {NORM_SQL.replace("(text,", "(c,")} AS c FROM chunk),
v AS (SELECT source, chunk_no, md5(lower(c)) AS hash, len(c) >= 20 AND len(regexp_replace(c, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(len(c), 1) <= 0.4 AS valid FROM n),
f AS (SELECT hash, arg_min(source, (source, chunk_no)) AS source FROM v WHERE valid GROUP BY hash),
a AS (SELECT source, count(*) AS inserted FROM f GROUP BY source)
SELECT source, count(*) AS chunks, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS invalid, coalesce(any_value(inserted), 0) AS inserted, count(*) FILTER (WHERE valid) - coalesce(any_value(inserted), 0) AS duplicates
FROM v LEFT JOIN a USING (source) GROUP BY source""")
def q_ingest(t):
    return ingest.ingested(t("documents"))[1]


@query(f"WITH {EDGES_SQL} SELECT source, relation, target, CAST(len(coalesce(sources, [])) AS INT) AS source_count, created FROM graph")
def q_graph_upsert(t):
    return graph.merged(graph.provenance(edge_table(t)), triple_table(t))[1]


@query(f"WITH {EDGES_SQL} SELECT relation, count(*) AS n FROM graph GROUP BY relation")
def q_type_counts(t):
    return graph.type_counts(full_graph(t))


def name_queries(t) -> DataFrame:
    return t("part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.array("p_name").alias("terms"))


MATCHED_SQL = f"""{EDGES_SQL},
nq AS (SELECT p_partkey AS query_id, lower(p_name) AS term FROM part WHERE p_partkey % 50 = 0),
matched AS (SELECT query_id, source, relation, target, coalesce(sources, []) AS sources, 10 * (lower(source) = term)::INT + 10 * (lower(target) = term)::INT + 2 * contains(lower(source), term)::INT + 2 * contains(lower(target), term)::INT AS score FROM graph, nq)"""
BEST_SQL = f"""{MATCHED_SQL},
capped AS (SELECT * FROM matched WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(sources) DESC, source, relation, target) <= 200),
pairs AS (SELECT *, {PRIORITY_SQL} AS pr, least(len(sources), 10) AS ns FROM capped WHERE len(sources) > 0 QUALIFY row_number() OVER (PARTITION BY query_id, lower(source), lower(target) ORDER BY score DESC, {PRIORITY_SQL} DESC, least(len(sources), 10) DESC, source, relation, target) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr DESC, ns DESC, source, relation, target) AS rank FROM pairs)"""


@query(f"WITH {BEST_SQL} SELECT query_id, source, relation, target, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM best WHERE rank <= 10")
def q_graph_search(t):
    return graph.search(full_graph(t), name_queries(t)).select("query_id", *graph.EDGE, "score", "rank")


@query(f"""WITH {BEST_SQL} SELECT query_id, source, relation, target, round(0.5 * least(score / 10.0, 1) + 0.3 * pr / 80.0 + 0.2 * least(len(sources) / 5.0, 1), 4) AS graph_score, CAST(rank AS INT) AS rank FROM best WHERE rank <= 10""")
def q_graph_fallback(t):
    return graph.fallback_search(full_graph(t), name_queries(t)).select("query_id", *graph.EDGE, "graph_score", "rank")


@query(f"""WITH {EDGES_SQL}, c AS (SELECT *, count(DISTINCT relation) OVER (PARTITION BY source, target) AS types FROM graph)
SELECT source, target, relation, row_number() OVER (PARTITION BY source, target ORDER BY {PRIORITY_SQL} DESC, least(len(sources), 25) DESC, len(relation), relation DESC) = 1 AS winner FROM c WHERE types > 1""")
def q_conflict_winner(t):
    return graph.conflicts(full_graph(t)).select("source", "target", "relation", "winner")


@query(f"""WITH {EDGES_SQL} SELECT source, target, first(relation ORDER BY {PRIORITY_SQL} DESC, least(len(sources), 25) DESC, len(relation), relation DESC) AS relation, array_to_string(list_sort(list(DISTINCT relation)), ',') AS merged, CAST(len(list_distinct(flatten(list(coalesce(sources, []))))) AS INT) AS source_count FROM graph GROUP BY source, target""")
def q_conflict_resolved(t):
    known = stored(graph.merged(graph.provenance(edge_table(t)), triple_table(t))[0], "provenance")
    return graph.resolved_pairs(known).select("source", "target", "relation", F.array_join("merged_types", ",").alias("merged"), "source_count")


@query("""WITH e AS (SELECT s_name AS source, n_name AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS name FROM nation WHERE n_name NOT IN (SELECT target FROM e) UNION ALL SELECT c_name FROM customer""")
def q_isolated(t):
    nodes = t("nation").select(F.col("n_name").alias("name")).union(t("customer").select("c_name"))
    return graph.isolated(nodes, edge_table(t).where("relation = 'runs_on'"))


def raw_edges(t) -> DataFrame:
    """Edges with other spellings: brands and names of parts."""
    kind = F.element_at(X.literals(("used by", "Depends-On", "provide", "unknown link")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select(F.col("p_name").alias("source"), kind.alias("relation"), F.lower("p_brand").alias("target"), F.array(F.concat(F.lit("p"), F.col("p_partkey") % 7)).alias("sources"))


@query("""WITH p AS (SELECT *, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]) AS ws FROM part),
r AS (SELECT array_to_string(ws, ' ') AS source, CASE p_partkey % 4 WHEN 0 THEN 'uses' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'provides' END AS relation, 'Brand' || p_brand[6:] AS target, 'p' || (p_partkey % 7) AS s FROM p)
SELECT source, relation, target, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources FROM r WHERE relation IS NOT NULL GROUP BY source, relation, target""")
def q_graph_cleanup(t):
    return graph.cleaned(raw_edges(t)).select(*graph.EDGE, F.array_join("sources", ",").alias("sources"))


def spelled_edges(t) -> DataFrame:
    """raw_edges, and suppliers in nations: those are kept."""
    runs = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    kept = runs.select(F.concat(F.lit("Supplier"), F.col("s_suppkey") % 9).alias("source"), F.lit("runs_on").alias("relation"), F.concat(F.lit("Nation"), "n_nationkey").alias("target"), F.array().cast("array<string>").alias("sources"))
    return raw_edges(t).unionByName(kept)


CLEANUP_SQL = """p AS (SELECT *, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]) AS ws FROM part),
r AS (SELECT p_name AS s, lower(p_brand) AS o, array_to_string(ws, ' ') AS source, CASE p_partkey % 4 WHEN 0 THEN 'uses' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'provides' END AS relation, 'Brand' || p_brand[6:] AS target FROM p),
k AS (SELECT 'Supplier' || (s_suppkey % 9) AS source, 'Nation' || s_nationkey AS target FROM supplier),
after AS (SELECT source, target FROM r WHERE relation IS NOT NULL UNION ALL SELECT * FROM k),
names AS (SELECT source AS name FROM after UNION SELECT target FROM after)"""


@query(f"WITH {CLEANUP_SQL} SELECT name FROM names")
def q_cleanup_nodes(t):
    return graph.cleanup(t("customer").select(F.col("c_name").alias("name")), spelled_edges(t))[0]


@query(f"""WITH {CLEANUP_SQL}, b AS (SELECT s AS name FROM r UNION SELECT o FROM r UNION SELECT source FROM k UNION SELECT target FROM k UNION SELECT c_name FROM customer)
SELECT (SELECT count(*) FROM r) + (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k) AS keep, (SELECT count(*) FROM r WHERE relation IS NULL) AS "delete", (SELECT count(*) FROM r WHERE relation IS NOT NULL) AS rewrite,
  (SELECT count(*) FROM b WHERE name NOT IN (SELECT name FROM names)) AS isolated_nodes_deleted, (SELECT count(DISTINCT p_partkey % 4) FROM part) AS invalid_types""")
def q_cleanup_totals(t):
    return graph.cleanup(t("customer").select(F.col("c_name").alias("name")), spelled_edges(t))[2]


@query(f"WITH {EDGES_SQL}, p AS (SELECT * FROM graph WHERE contains(lower(source), 'ring') OR contains(lower(target), 'ring') ORDER BY source, relation, target LIMIT 100) SELECT DISTINCT name FROM (SELECT source AS name FROM p UNION ALL SELECT target FROM p)")
def q_graph_data(t):
    return graph.neighbourhood(full_graph(t), "ring")[0]


BM25_SQL = f"""{EDGES_SQL},
names AS (SELECT source AS name FROM graph UNION SELECT target FROM graph),
tok AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM names),
posts AS (SELECT name, len, word, count(*) AS tf FROM (SELECT name, len(ws) AS len, unnest(ws) AS word FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM tok), dfs AS (SELECT word, count(*) AS df FROM posts GROUP BY word),
asked AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS word FROM part WHERE p_partkey % 50 = 0),
bm AS (SELECT query_id, name, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM posts JOIN asked USING (word) JOIN dfs USING (word), st GROUP BY query_id, name),
top20 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM bm QUALIFY rank <= 20)"""


@query(f"WITH {BM25_SQL} SELECT query_id, name, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM top20")
def q_bm25(t):
    g = full_graph(t)
    names = g.select(F.col("source").alias("name")).union(g.select("target"))
    return graph.bm25(names, name_queries(t)).withColumn("score", F.round("score", 4))


@query(f"""WITH {BM25_SQL},
hop AS (SELECT query_id, source, relation, target, max(score) AS ft, any_value(coalesce(sources, [])) AS sources FROM graph JOIN top20 ON name = source OR name = target GROUP BY ALL),
cap AS (SELECT *, round(0.5 * least(ft / 4, 1) + 0.3 * ({PRIORITY_SQL}) / 80.0 + 0.2 * least(len(sources) / 5.0, 1), 4) AS g FROM hop QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ft DESC, source, relation, target) <= 60),
one AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY query_id, lower(source), lower(target) ORDER BY g DESC, source, relation, target) = 1),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, source, relation, target) AS rank FROM one)
SELECT query_id, source, relation, target, g AS graph_score, CAST(rank AS INT) AS rank FROM fin WHERE rank <= 10""")
def q_graph_scored(t):
    return graph.scored_search(full_graph(t), name_queries(t)).select("query_id", *graph.EDGE, "graph_score", "rank")


EVIDENCE_SQL = f"""WITH {TERMS_SQL},
ev AS (SELECT query_id, term FROM (SELECT query_id, term, min(o) AS o FROM (
    SELECT item_id AS query_id, unnest(list_transform(regexp_split_to_array(trim(replace(lower(text), '_', ' ')), '\\s+'), lambda w: trim(w, '.,:;!?()[]{{}}''"`-/'))) AS term, generate_subscripts(regexp_split_to_array(trim(replace(lower(text), '_', ' ')), '\\s+'), 1) AS o FROM benchmark WHERE item_id % 50 = 0)
  WHERE len(term) >= 3 AND term NOT IN ('and', 'are', 'czy', 'dla', 'for', 'jak', 'jest', 'kto', 'mowi', 'mówi', 'oraz', 'the', 'with', 'wczoraj') GROUP BY query_id, term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= 30),
looked AS (SELECT query_id, chunk_id, content, source FROM chunks, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 500),
h AS (SELECT l.query_id, chunk_id, source, count(*) AS hits FROM looked l JOIN ev ON ev.query_id = l.query_id AND contains(lower(content), term) GROUP BY ALL),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY hits DESC, chunk_id) = 1)
SELECT query_id, chunk_id, source, CAST(hits AS INT) AS hits, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS INT) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) <= 6"""


@query(EVIDENCE_SQL)
def q_evidence(t):
    chunks = chunk_texts(t)
    asked = query_table(t).select("query_id", X.evidence_terms(F.col("query")).alias("terms"))
    wanted = chunks.select("source").distinct().crossJoin(F.broadcast(asked))
    return search.evidence(chunks, wanted).select("query_id", "chunk_id", "source", "hits", "rank")


@query(EVIDENCE_SQL.replace(" QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 500", ""))
def q_evidence_all(t):
    """q_evidence over all chunks of all documents: no vector is needed, and no 500 chunks are the first."""
    chunks = chunk_texts(t)
    asked = query_table(t).select("query_id", X.evidence_terms(F.col("query")).alias("terms"))
    wanted = chunks.select("source").distinct().crossJoin(F.broadcast(asked))
    return search.evidence(chunks, wanted, most=None).select("query_id", "chunk_id", "source", "hits", "rank")


def candidate_table(t) -> DataFrame:
    """The vector and the lexical path (as evidence) of each query."""
    rows = search.hybrid(chunk_table(t), query_table(t)).join(t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source"), "chunk_id")
    vector = F.col("path") == "vector"
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("ordinal")) - 1
    return rows.select(
        "query_id", F.when(vector, "vector").otherwise("evidence").alias("path"), rank.alias("rank"), "content", "source", F.when(vector, "vector").otherwise("graph_evidence").alias("type"),
        F.when(vector, S.calibrated_score(F.col("distance"))).otherwise(F.least(F.col("lexical_score") / 40.0, F.lit(1.0))).alias("score"), F.lit(None).cast("string").alias("traversal"),
    )


@query(f"""WITH {HYBRID_SQL},
cand AS (SELECT query_id, CASE path WHEN 'vector' THEN 'vector' ELSE 'evidence' END AS path, row_number() OVER (PARTITION BY query_id, path ORDER BY ordinal) - 1 AS rank, content, source,
  CASE path WHEN 'vector' THEN exp(-greatest(distance, 0) / 30) ELSE least(lexical_score / 40.0, 1) END AS score FROM hybrid JOIN chunks USING (chunk_id)),
k AS (SELECT *, substr(md5(source || '|' || substr(content, 1, 200)), 1, 16) AS key FROM cand),
g AS (SELECT query_id, key, max(score) FILTER (WHERE path = 'vector') AS v, max(score) FILTER (WHERE path = 'evidence') AS e, sum(CASE path WHEN 'vector' THEN 0.5 ELSE 0.2 END / (61 + rank)) AS rrf, count(DISTINCT path) AS n, min(path) AS p,
  min(CASE path WHEN 'vector' THEN 0 ELSE 1000000 END + rank) AS f FROM k GROUP BY query_id, key),
s AS (SELECT *, round(least(greatest(coalesce(v, 0), coalesce(e, 0) * 0.7) + 0.15 * least(rrf / ((0.5 + 0.3 + 0.2) / 61), 1), 1), 4) AS fused_score FROM g)
SELECT query_id, key, fused_score, CASE WHEN n > 1 THEN 'multi_path(vector|evidence)' ELSE p || '_primary' END AS reason, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, f) AS INT) AS fused_rank FROM s""")
def q_rrf_fusion(t):
    return fusion.fused(candidate_table(t)).select("query_id", "key", "fused_score", "reason", "fused_rank")


@query(rf"""WITH {whole_table(RERANK_SQL)}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(content)) ORDER BY rank) AS seen FROM ranked WHERE len(trim(content)) >= 30),
f AS (SELECT query_id, chunk_id, content, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM s WHERE seen = 1 QUALIFY place <= 20)
SELECT query_id, chunk_id, md5(lower(trim(content))) AS same, CAST(place AS INT) AS ordinal FROM f""")
def q_first_hits(t):
    """The hits that contexts are made from, for every benchmark item: hybrid search of all documents, reranked and cleaned."""
    rows = pipelines.first_hits(chunk_table(t), item_table(t), 20)
    return rows.select("query_id", "chunk_id", F.md5(F.lower(X.stripped(F.col("content")))).alias("same"), F.col("rank").alias("ordinal"))


@query()
def q_relevance_gate(t):
    """The gate's verdict on the first hits of every benchmark item."""
    queries = item_table(t)
    hits = pipelines.first_hits(chunk_table(t), queries, 5)
    items = hits.select("query_id", F.col("rank").alias("ordinal"), F.lit("vector").alias("type"), "content", "source", "tags", S.live_score(F.col("distance")).alias("score"), "distance")
    return gate.decided(queries, items)[0]


@query("""SELECT source AS query_id, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(len(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 12000""")
def q_pack_prefix(t):
    items = t("documents").select(F.col("source").alias("query_id"), "doc_id", F.col("text").alias("content"))
    return context.prefix(items, 12000, order="doc_id").select("query_id", "doc_id", "used")


@query()
def q_pack_truncate(t):
    """The hits of every benchmark item under a budget."""
    chunks, queries = chunk_table(t), item_table(t)
    hits = search.reranked(search.hybrid(chunks, queries), chunks, queries).where("rank <= 20")
    items = hits.select("query_id", F.col("rank").alias("ordinal"), F.lit("vector").alias("type"), "content", "chunk_id")
    return context.packed(items).select("query_id", "ordinal", "chunk_id", "truncated", F.length("content").alias("n_chars"))


@query()
def q_hybrid_context(t):
    items, _ = pipelines.hybrid_context(chunk_table(t), query_table(t), edge_table(t))
    return items.select("query_id", "ordinal", "type", "source", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"), F.round("s", 6).alias("score"), "accepted")


# A second query set, in the words of the tables: what runs on a nation, with words that documents hold. Sources lie in one folder, as evidence
# comes from the folders that hits come from.


def wiki_chunks(t) -> DataFrame:
    """Documents in chunks; a document's first one has its vector."""
    pieces = chunking.chunks(t("documents").select("doc_id", "source", "lang", "text"))
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_no"), "embedding")
    rows = stored(pieces.join(vectors, ["doc_id", "chunk_no"], "left"), "wiki")
    return rows.select((F.col("doc_id") * 100_000 + F.col("chunk_no")).alias("chunk_id"), F.col("chunk").alias("content"), F.concat(F.lit("wiki/"), "source").alias("source"), F.array("lang").alias("tags"), F.lit("{}").alias("metadata"), "embedding")


def wiki_edges(t) -> DataFrame:
    return edge_table(t).withColumn("sources", F.transform("sources", lambda s: F.concat(F.lit("wiki/"), s)))


def nation_queries(t) -> DataFrame:
    names = t("nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("tell what runs on "), "n_name", F.lit(" with thention and ering tions")).alias("query"))
    return names.join(t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


@query()
def q_hybrid_context_names(t):
    """Contexts with hits, relations and evidence."""
    items, _ = pipelines.hybrid_context(wiki_chunks(t), nation_queries(t), wiki_edges(t))
    return items.select("query_id", "ordinal", "type", "source", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"), F.round("s", 6).alias("score"), "accepted")


@query()
def q_retrieved(t):
    """What a caller is told of each query, with at most eight results."""
    records = pipelines.retrieved(wiki_chunks(t), nation_queries(t), wiki_edges(t), top_k=8)[1]
    return records.withColumns({"types": F.to_json("types"), "sources": F.array_join("sources", ","), "top_score": F.round("top_score", 6)})


@query()
def q_hybrid_context_fused(t):
    """Fused contexts of every benchmark item; all edges and chunks found are scored."""
    items, _ = pipelines.hybrid_context_fused(chunk_table(t), item_table(t), edge_table(t), whole=True)
    return items.select("query_id", "ordinal", "type", "source", F.md5("content").alias("content_md5"), F.round("s", 6).alias("score"), "accepted")


@query()
def q_answer_context(t):
    return pipelines.answer_context(chunk_table(t), query_table(t)).select("query_id", "chunk_id", "rank", "used")


@query("""SELECT conv_id, turn, md5(text) AS question_md5, md5(answer) AS answer_md5 FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def q_qa_pairs(t):
    return conversations.pairs(t("conversations")).select("conv_id", "turn", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


@query(rf"""WITH p AS (SELECT conv_id, turn, text AS q, lead(role) OVER w AS next_role, lead(text) OVER w AS a, role FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, q, a, lower(q || chr(10) || a) AS text FROM p WHERE role = 'user' AND next_role = 'assistant'),
y AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_any_sql(ws)} THEN '{tag}' END" for tag, ws in V.TECH_TAGS.items())}], lambda z: z IS NOT NULL) AS found, regexp_matches(text, '{V.CODE_SIGNAL}') AS code, {_any_sql(V.OTHER_SUBJECTS)} AS other FROM x),
r AS (SELECT *, CASE WHEN len(q) < 30 OR len(a) < 60 THEN 'too_short' WHEN len(found) > 0 AND (code OR len(found) >= 2) THEN 'quick_technical_match' WHEN other AND len(found) = 0 AND NOT code THEN 'quick_non_technical_match'
  WHEN len(found) = 0 AND NOT code THEN 'no_technical_signal' ELSE 'needs_llm' END AS reason FROM y)
SELECT conv_id, turn, CASE reason WHEN 'quick_technical_match' THEN 'keep' WHEN 'needs_llm' THEN 'llm' ELSE 'reject' END AS decision, reason,
  CASE WHEN reason IN ('quick_technical_match', 'needs_llm') THEN array_to_string(found[1:10], ',') ELSE '' END AS tags FROM r""")
def q_qa_classify(t):
    return conversations.classified(conversations.pairs(t("conversations"), True)).select("conv_id", "turn", "decision", "reason", F.array_join("tags", ",").alias("tags"))


@query("""SELECT conv_id, turn, role, CAST(back AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6""")
def q_history_last6(t):
    return conversations.last_turns(t("conversations")).select("conv_id", "turn", "role", "back")


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^([^:/?#]+://[^/?#]*)', 1)) AS head, regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?]*)', 1) AS path, regexp_extract(u, '(\?.+)$', 1) AS q FROM u)
SELECT page_id, head || CASE WHEN path = '' THEN '/' WHEN path <> '/' AND path LIKE '%/' THEN path[:-2] ELSE path END || q AS url FROM p""")
def q_canonical_url(t):
    return t("pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '#.*$', ''), '^[^:/?#]+://[^/?#]*([^?]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN path = '' THEN '/' WHEN list_filter(string_split(path, '/'), lambda x: x <> '')[2] = 'docs' THEN '/' || list_filter(string_split(path, '/'), lambda x: x <> '')[1] || '/' WHEN path LIKE '%/' THEN path
  WHEN contains(string_split(path, '/')[-1], '.') THEN regexp_replace(path, '/[^/]*$', '') || '/' ELSE path || '/' END AS scope FROM p""")
def q_scope_key(t):
    return t("pages").select("page_id", X.scope_prefix(F.col("url")).alias("scope"))


@query()
def q_page_text(t):
    return web.read(t("pages")).select("page_id", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), F.size("links").alias("n_links"))


@query("SELECT event_type, count(*) AS n, CAST(trunc(avg(value)) AS BIGINT) AS avg_elapsed, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def q_telemetry_by_type(t):
    rows = t("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").cast("long").alias("avg_elapsed"), F.sum("k").alias("total"))


@query("SELECT count(*) AS n, CAST(trunc(avg(value)) AS BIGINT) AS avg_elapsed, CAST(trunc(avg(len(props))) AS BIGINT) AS avg_chars, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS used FROM events")
def q_telemetry_summary(t):
    return telemetry.summary(t("events").select(F.col("value").alias("elapsed_ms"), F.length("props").alias("chars"), (F.col("event_type") != "error").alias("used")))


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def q_telemetry_tail(t):
    return telemetry.tail(t("events")).select("event_id", "event_type", "value")


@query("SELECT doc_id, quality, toxic FROM labels ORDER BY doc_id DESC LIMIT 50")
def q_feedback_recent(t):
    return telemetry.tail(t("labels"), 50, ("doc_id",)).select("doc_id", "quality", "toxic")


@query("SELECT item_id, count(doc_id) AS n_documents, count(doc_id) > 0 AS passed FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def q_golden(t):
    """Benchmark items as golden tests: is any document's text found that contains the item?"""
    rows = telemetry.containing(t("benchmark").select("item_id", F.col("text").alias("wanted")), t("documents").select("doc_id", "text"))
    return rows.select("item_id", "n_documents", (F.col("n_documents") > 0).alias("passed"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(*) FILTER (WHERE len(text) >= 250) AS n_long FROM documents GROUP BY source")
def q_source_rollup(t):
    return t("documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count_if(F.length("text") >= 250).alias("n_long"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, lower(host) || CASE WHEN len(parts) > 0 THEN '/' || array_to_string(parts[1:2], '/') ELSE '' END AS scope FROM p""")
def q_source_scope(t):
    return t("pages").select("page_id", X.source_scope(F.col("url")).alias("scope"))


@query(f"""WITH q AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT conv_id, turn, {NORM_SQL} AS q, {NORM_SQL.replace("(text,", "(answer,")} AS a FROM q WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, 'chatgpt' AS source, md5('# ChatGPT Q/A' || chr(10) || chr(10) || '#chatgpt' || chr(10) || chr(10) || '## Pytanie' || chr(10) || q || chr(10) || chr(10) || '## Odpowiedź' || chr(10) || a || chr(10)) AS text_md5
FROM n WHERE len(q) >= 30 AND len(a) >= 30""")
def q_qa_import(t):
    rows = conversations.imported(conversations.pairs(t("conversations")))
    return rows.select("conv_id", "turn", "source", F.md5("text").alias("text_md5"))


@query("""WITH p AS (SELECT *, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]) AS ws FROM part),
r AS (SELECT array_to_string(ws, ' ') = p_name AND 'Brand' || p_brand[6:] = lower(p_brand) AND p_partkey % 4 = 9 AS same, p_partkey % 4 = 3 AS gone FROM p)
SELECT CASE WHEN gone THEN 'delete' WHEN same THEN 'keep' ELSE 'rewrite' END AS action, count(*) AS n FROM r GROUP BY 1""")
def q_cleanup_report(t):
    return graph.cleanup_report(raw_edges(t))[0]


@query("""WITH e AS (SELECT n_name AS s, 'is_a' AS r, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, 'runs_on', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT r) FROM e) AS types,
  (SELECT count(*) FROM n WHERE name NOT IN (SELECT s FROM e) AND name NOT IN (SELECT t FROM e)) AS isolated""")
def q_graph_counts(t):
    nodes = t("nation").select(F.col("n_name").alias("name")).union(t("region").select("r_name")).union(t("supplier").select("s_name")).union(t("customer").select("c_name")).distinct()
    return graph.counts(nodes, edge_table(t))


def _count_sql(words, text: str = "text") -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


def _has_sql(words, text: str = "lq") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


#: RERANK_SQL over the rows of ``asked`` (item_id, text, wanted, tag), of which a tag is the only language to search.
ASKED_SQL = (
    RERANK_SQL.replace("FROM benchmark WHERE item_id % 50 = 0)\n", "FROM asked)\n")
    .replace("q AS (SELECT b.item_id AS query_id, b.text AS query, e.embedding AS wanted FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE b.item_id % 50 = 0)", "q AS (SELECT item_id AS query_id, text AS query, wanted, tag FROM asked)")
    .replace("JOIN q USING (query_id) GROUP BY q.query_id", "JOIN q USING (query_id) WHERE tag IS NULL OR tag = lang GROUP BY q.query_id")
    .replace("FROM chunks, q WHERE embedding IS NOT NULL", "FROM chunks, q WHERE embedding IS NOT NULL AND (tag IS NULL OR tag = lang)")
)


@query(rf"""WITH w AS (SELECT item_id AS id, unnest([0, 1]) AS variant, unnest([trim(text, ' ' || chr(9) || chr(10) || chr(13)), trim(substr(text, 1, len(text) // 2), ' ' || chr(9) || chr(10) || chr(13))]) AS text, unnest([vec_id, vec_id + 1]) AS v
  FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % 50 = 0),
asked AS (SELECT id * 4 + variant * 2 + turn AS item_id, id, variant, turn, text, embedding AS wanted, CASE turn WHEN 0 THEN 'en' END AS tag FROM w JOIN embeddings ON vec_id = v, (SELECT unnest([0, 1]) AS turn)),
{ASKED_SQL},
found AS (SELECT id, variant, turn, chunk_id, rank, content, md5(lower(trim(content, ' ' || chr(9) || chr(10) || chr(13)))) AS same FROM ranked JOIN asked ON item_id = ranked.query_id),
one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY variant, turn, rank) AS ordinal FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id, same ORDER BY variant, turn, rank) = 1)),
whole AS (SELECT id, lower(string_agg(text, chr(10) ORDER BY variant)) AS lq FROM w GROUP BY id),
points AS (SELECT id AS query_id, chunk_id, ordinal,
    CASE WHEN {_has_sql(answers.CLUSTER)} THEN 8 * {_count_sql(answers.CLUSTER_PHRASES)} - CASE WHEN contains(text, 'oauth') AND NOT {_has_sql(answers.LOGIN)} THEN 12 ELSE 0 END ELSE 0 END
    + CASE WHEN {_has_sql(answers.POD)} THEN 8 * {_count_sql(answers.POD_PHRASES)} ELSE 0 END
    + len(list_filter(list_transform(regexp_split_to_array(lq, '\s+'), lambda x: trim(x, '.,:;!?()[]{{}}''"`')), lambda x: len(x) >= 4 AND contains(text, x))) AS points
  FROM (SELECT *, lower(content) AS text FROM one JOIN whole USING (id)))
SELECT query_id, chunk_id, CAST(ordinal AS INT) AS ordinal, CAST(row_number() OVER (PARTITION BY query_id ORDER BY points DESC, ordinal) AS INT) AS priority FROM points QUALIFY priority <= 20""")
def q_variant_search(t):
    """Another wording, the query's first half, with a vector of its own."""
    half = F.array(F.substring("query", F.lit(1), F.floor(F.length("query") / 2).cast("int")))
    other = t("embeddings").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("other"))
    queries = query_table(t).join(other, "query_id")
    return pipelines.variant_search(chunk_table(t), queries, tags=["en"], hints=half, embed=lambda _: F.col("other")).select("query_id", "chunk_id", "ordinal", "priority")


@query(r"""WITH c AS (SELECT url, page_id % 3 = 0 AS known FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url))
SELECT count(*) AS pages_found, count(*) FILTER (WHERE NOT known) AS pages_imported, count(*) FILTER (WHERE known) AS duplicate_pages, CAST(0 AS BIGINT) AS deleted_chunks FROM c""")
def q_website_import(t):
    """All pages as if crawled; every third address is a source already."""
    first = t("pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    found = web.read(first).select("url", "title", "text")
    known = first.where("page_id % 3 = 0").select(F.col("url").alias("source"))
    return web.imported(found, known)[2]


_SITE_SQL = CHUNKS_SQL.replace("FROM documents)", "FROM (SELECT doc_id, 'https://wiki/' || doc_id AS source, '# Doc ' || doc_id || chr(10) || chr(10) || 'Source: https://wiki/' || doc_id || chr(10) || chr(10) || text AS text FROM documents))")


@query(rf"""WITH RECURSIVE {_SITE_SQL},
n AS (SELECT source, chunk_no, {NORM_SQL.replace("(text,", "(c,")} AS c FROM chunk),
v AS (SELECT md5(lower(c)) AS hash, len(c) >= 20 AND len(regexp_replace(c, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(len(c), 1) <= 0.4 AS valid FROM n)
SELECT (SELECT count(*) FROM documents) AS pages_found, (SELECT count(*) FROM documents) AS pages_imported, CAST(0 AS BIGINT) AS duplicate_pages, (SELECT CAST(sum(1 + doc_id % 2) AS BIGINT) FROM documents WHERE doc_id % 3 = 0) AS deleted_chunks,
  count(*) AS chunks, count(*) FILTER (WHERE valid) AS valid, count(DISTINCT hash) FILTER (WHERE valid) AS inserted, count(*) FILTER (WHERE valid) - count(DISTINCT hash) FILTER (WHERE valid) AS duplicates, count(*) FILTER (WHERE NOT valid) AS invalid,
  CAST(0 AS BIGINT) AS graph_valid, CAST(0 AS BIGINT) AS graph_created, CAST(0 AS BIGINT) AS graph_existing FROM v""")
def q_website_totals(t):
    """Every document as a page; every third is a source of one or two chunks already and is read anew."""
    url = F.concat(F.lit("https://wiki/"), "doc_id")
    found = t("documents").select(url.alias("url"), F.concat(F.lit("Doc "), "doc_id").alias("title"), "text")
    known = t("documents").where("doc_id % 3 = 0").select(url.alias("source"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 2)).alias("n"))
    return pipelines.website_import(found, known.withColumn("hash", F.md5(F.concat_ws("-", "source", "n"))), reindex=True)[3]


@query()
def q_document_relations(t):
    return anchors.relations(t("documents").select("source", "text")).groupBy("source", "relation", "target").agg(F.count("*").alias("n"))


# Steps that ask a model: a deterministic stand-in answers from the prompt alone, with replies that leave items out or can't be read.


def pairs_model(prompt: str) -> str:
    """Keeps questions of even length, tags them by length, and says nothing of every seventh length."""
    items = json.loads(prompt[len(models.PAIRS_PROMPT) :])
    said = [{"id": x["id"], "keep": len(x["question"]) % 2 == 0, "tags": [f"#Tag{len(x['answer']) % 5}", " "], "reason": f"n{len(x['question'])}"} for x in items if len(x["question"]) % 7]
    return f"Here you are: {json.dumps(said)} Bye."


def tag_model(prompt: str) -> str:
    """Tags and wording by the length of what it is shown; every seventh reply can't be read."""
    shown = next(prompt[len(p) :] for p in (models.DOCUMENT_PROMPT, models.QUERY_PROMPT, models.REWRITE_PROMPT) if prompt.startswith(p))
    n = len(shown)
    return "Sorry." if n % 7 == 0 else f"Sure: {json.dumps({'tags': [f'#Tag{n % 5}', ' ', f'Len{n % 3}'], 'query': f' question {n} ', 'reason': f'n{n}'})}"


def rerank_model(prompt: str) -> str:
    """Names passages by the length of the question, some of which there aren't; every fifth reply names none."""
    n = len(prompt.split("\nQuestion:\n", 1)[1].split("\nPassages:\n", 1)[0])
    return "I can't say." if n % 5 == 0 else f"Best: {[(n * k) % 23 for k in range(1, 9)]}"


def triples_model(prompt: str) -> str:
    """What the two headings of a paper have to do with each other, twice, and two things that can't stay."""
    name, kind = re.findall(r"(?m)^#+ (.*)$", prompt[len(models.TRIPLES_PROMPT) :])
    said = [("uses", kind), ("used by", kind.lower()), ("unknown link", kind), ("provides", "Somewhere Else")]
    return json.dumps([{"source": name, "relation": r, "target": t} for r, t in said] + ["no object"])


@query("""WITH p AS (SELECT conv_id, turn, text AS q, lead(role) OVER w AS next_role, lead(text) OVER w AS a, role FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, least(len(q), 1200) AS n, least(len(a), 2400) AS m FROM p WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, n % 7 > 0 AND n % 2 = 0 AS keep, CASE WHEN n % 7 > 0 THEN 'tag' || (m % 5) ELSE '' END AS tags, CASE WHEN n % 7 > 0 THEN 'n' || n ELSE 'missing_llm_batch_decision' END AS why FROM x""")
def q_qa_decisions(t):
    """All question-answer pairs, decided by a model in batches of twelve; equal pairs are asked about once."""
    qa = conversations.pairs(t("conversations"), True).select("conv_id", "turn", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    return models.pairs_decided(qa, pairs_model).select("conv_id", "turn", "keep", F.array_join("told", ",").alias("tags"), "why")


@query(f"""WITH near AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2_SQL.format(a="a.embedding", b="b.embedding")}, b.vec_id) AS ordinal FROM embeddings a, embeddings b
  WHERE a.vec_id % 50 = 0 AND a.vec_id IN (SELECT doc_id FROM documents) AND b.vec_id IN (SELECT doc_id FROM documents) QUALIFY ordinal <= 20),
q AS (SELECT query_id, any_value(len(left(text, 200))) AS n, count(*) AS hits FROM near JOIN documents ON doc_id = query_id GROUP BY query_id),
named AS (SELECT query_id, k, (n * k) % 23 AS place, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM q, (SELECT unnest(range(1, 9)) AS k) WHERE n % 5 > 0 AND (n * k) % 23 < hits),
picked AS (SELECT query_id, place, rank FROM named WHERE rank <= 6 UNION ALL SELECT query_id, ordinal - 1, ordinal FROM near WHERE ordinal <= 6 AND query_id NOT IN (SELECT query_id FROM named))
SELECT p.query_id, chunk_id, CAST(rank AS INT) AS rank FROM picked p JOIN near ON near.query_id = p.query_id AND ordinal = place + 1""")
def q_rerank_model(t):
    """The nearest 20 documents of each query, put in order by a model."""
    texts = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    asked = vector_queries(t).join(texts.withColumnRenamed("chunk_id", "query_id"), "query_id").select("query_id", F.left("content", F.lit(200)).alias("query"), "embedding")
    near = search.vector_top(vector_chunks(t).join(texts.select("chunk_id"), "chunk_id", "left_semi"), asked, 20)
    hits = near.withColumnRenamed("rank", "ordinal").join(texts, "chunk_id")
    return models.model_reranked(hits, asked, rerank_model).select("query_id", "chunk_id", "rank")


_TOLD_SQL = "CASE WHEN n % 7 > 0 THEN 'tag' || (n % 5) || ',len' || (n % 3) ELSE '' END AS tags, CASE WHEN n % 7 > 0 THEN 'n' || n ELSE 'failed_to_parse_llm_response' END AS why"


@query(f"WITH x AS (SELECT doc_id, len(coalesce(source, '')) + 1 + least(len(coalesce(text, '')), 6000) AS n FROM documents) SELECT doc_id, {_TOLD_SQL} FROM x")
def q_documents_tagged(t):
    """All documents, tagged by a model."""
    return models.documents_tagged(t("documents"), tag_model).select("doc_id", F.array_join("told", ",").alias("tags"), "why")


@query(f"WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS q, len(coalesce(text, '')) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_TOLD_SQL}, md5(CASE WHEN n % 7 > 0 THEN 'question ' || n ELSE q END) AS wording_md5 FROM x")
def q_questions_asked(t):
    """All users' turns as questions: a model's tags to search with, and its wording."""
    asked = t("conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("query"))
    told = models.queries_tagged(asked, tag_model).withColumnRenamed("why", "tags_why")
    return models.rewritten(told, tag_model).select("conv_id", "turn", F.array_join("told", ",").alias("tags"), F.col("tags_why").alias("why"), F.md5("wording").alias("wording_md5"))


CLASSES = ("Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Omega")


def papers(t) -> DataFrame:
    """Every document as a paper of two headings and its whole text, in lower case and without signs of headings; three ids share a name."""
    name = F.concat(F.lit("Paper "), F.expr("doc_id div 3"))
    kind = F.concat(F.lit("Class "), F.get(X.literals(CLASSES), (F.length("text") % 7).cast("int")))
    text = F.concat(F.lit("# "), name, F.lit("\n\n## "), kind, F.lit("\n\n"), F.replace(F.lower("text"), F.lit("#"), F.lit(" ")))
    return t("documents").select("doc_id", F.concat(F.lit("paper-"), "doc_id", F.lit(".md")).alias("source"), text.alias("text"), name.alias("name"), kind.alias("kind"))


_ALIASES_SQL = ", ".join(f"('{alias.replace('_', ' ')}', '{name}')" for alias, name in V.ENTITY_ALIASES.items())


@query(f"""WITH alias(alias, name) AS (VALUES {_ALIASES_SQL}),
p AS MATERIALIZED (SELECT doc_id, 'Paper ' || (doc_id // 3) AS name, 'Class ' || ({list(CLASSES)})[len(text) % 7 + 1] AS kind, lower(text) AS lt FROM documents),
edges AS (SELECT DISTINCT name AS source, 'uses' AS relation, kind AS target FROM p WHERE doc_id % 4 = 0),
named AS (SELECT DISTINCT doc_id, p.name AS source, 'contains' AS relation, alias.name AS target FROM p, alias WHERE contains(lt, alias) AND contains(lt, lower(alias.name)) AND len(alias.name) >= 4),
u AS (SELECT doc_id, name AS source, unnest(['is_a', 'contains', 'uses']) AS relation, unnest(['dokument', kind, kind]) AS target FROM p UNION ALL SELECT * FROM named),
c AS (SELECT u.*, min(doc_id) OVER (PARTITION BY u.source, u.relation, u.target) = doc_id AND e.source IS NULL AS created FROM u LEFT JOIN edges e USING (source, relation, target))
SELECT doc_id, count(*) + 1 AS n_valid, count(*) AS n_unique, count(*) FILTER (WHERE created) AS n_created, count(*) FILTER (WHERE NOT created) AS n_existing, CAST(3 AS BIGINT) AS n_skipped FROM c GROUP BY doc_id""")
def q_relations_extracted(t):
    """Counters of what all papers say, by anchor and by a model, against a graph that has some of it."""
    pages = stored(papers(t), "papers")
    edges = pages.where("doc_id % 4 = 0").select(F.col("name").alias("source"), F.lit("uses").alias("relation"), F.col("kind").alias("target")).distinct()
    texts = pages.select("doc_id", "source", "text")
    return graph.change_set(models.with_triples(models.sampled(texts), triples_model), edges, whole=texts)[1]


DATA_PAGE = """{"page": "/p", "props": {"pageProps": {"metadata": {"title": "Page %s", "description": "About  page %s"}, "pageHeading": {"title": "Heading %s", "url": "/h"},
 "pageContent": {"z": {"body": ["first   text %s", {"deep": [["second text"], {"id": "no text", "note": "third \\u00e9 text"}]}], "url": "/in/%s"}, "a": "fourth text", "b": "/no text", "c": "ab", "d": "#no text", "href": "%s"},
 "other": [{"fullPath": "/other/%s?x=1"}, {"href": ""}]}}}"""
_DATA_SQL = " || CAST(page_id AS VARCHAR) || ".join("'" + x.replace("'", "''") + "'" for x in DATA_PAGE.split("%s"))


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, {_DATA_SQL} AS data FROM pages),
x AS (SELECT page_id, j.id AS n, regexp_replace(j.value ->> '$', '\s+', ' ', 'g') AS v FROM p, json_tree(p.data, '$.props.pageProps.pageContent') j
  WHERE j.type = 'VARCHAR' AND NOT regexp_matches(j.fullkey, '\.(url|href|fullPath|path|id|theme|iconName|leadingIconName)(\.|\[|$)')),
b AS (SELECT page_id, string_agg(v, chr(10) ORDER BY n) AS body FROM x WHERE len(v) > 2 AND v[1] NOT IN ('/', '#') GROUP BY page_id),
k AS (SELECT page_id, count(*) FILTER (WHERE len(j.value ->> '$') > 0) AS n_links FROM p, json_tree(p.data) j WHERE j.type = 'VARCHAR' AND j.key IN ('url', 'href', 'fullPath') GROUP BY page_id)
SELECT page_id, 'Page ' || page_id AS title, md5('# Page ' || page_id || chr(10) || 'About page ' || page_id || chr(10) || '# Heading ' || page_id || chr(10) || body) AS text_md5, CAST(n_links AS INT) AS n_links FROM b JOIN k USING (page_id)""")
def q_page_data(t):
    """Data planted in every page, as a script would leave it: objects and lists to any depth, in document order."""
    data = F.concat(*[x for part in DATA_PAGE.split("%s") for x in (F.lit(part), F.col("page_id").cast("string"))][:-1])
    html = F.concat(F.col("html"), F.lit('<script type="application/json" id="__NEXT_DATA__">'), F.replace(data, F.lit('"'), F.lit("&quot;")), F.lit("</script>"))
    rows = web.read_data(t("pages").select("page_id", "url", html.alias("html")))
    return rows.select("page_id", "title", F.md5("text").alias("text_md5"), F.size("links").alias("n_links"))
