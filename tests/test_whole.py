"""Queries that take every benchmark item, with a vector or not, at any id, and look at all of what they rank."""

import math
import random
import re
import shutil
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern import vocabulary as V
from quern.operators import context, graph, search
from quern.plans import catalogue, pipelines
from quern.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Items 1, 3 (no vector), 50, 51 and 52 (no text); documents with and without a vector, one of them twice."""
    at = tmp_path_factory.mktemp("tables")
    for name in ("nation", "region", "supplier"):
        shutil.copyfile(f"{SF}/{name}.parquet", at / f"{name}.parquet")
    say = lambda i: f"Document {i} tells of word{i % 7} and of other{i % 5} things at some length"
    docs = [(i, say(i % 40) + (" and more" * 500 if i % 3 == 0 else ""), "en", f"src{i % 4}") for i in range(60)]
    items = [(1, "word1 with other2"), (3, "word3 or other0, things"), (50, "word5"), (51, "nowhere else"), (52, None)]
    vectors = [(i, [float(i % 9), float(i % 4), 1.0]) for i in range(55) if i != 3]
    put = lambda name, names, rows: pq.write_table(pa.table([pa.array(c) for c in zip(*rows)], names), at / f"{name}.parquet")
    put("documents", ["doc_id", "text", "lang", "source"], docs)
    put("benchmark", ["item_id", "text"], items)
    put("embeddings", ["vec_id", "embedding"], vectors)
    return str(at)


def reader(spark, at):
    return lambda name: spark.read.parquet(f"{at}/{name}.parquet")


def by_sql(at, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    rows = con.sql(ORACLES[name])
    return rows.columns, sorted(rows.fetchall())


def by_spark(spark, at, name, columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, at).select(*columns).collect())


def test_first_hits_of_every_item(spark, tables):
    columns, want = by_sql(tables, "q_first_hits")
    assert by_spark(spark, tables, "q_first_hits", columns) == want
    assert {r[columns.index("query_id")] for r in want} == {1, 3, 50, 51, 52}


def test_texts_are_read_once_for_reranking(spark, tmp_path):
    """What only a text decides is worked out before the text meets its hits, and texts that aren't hit are left out."""
    chunks = spark.createDataFrame([(i, f"# words of {i}\nand more of some words", "s", ["t"], "", [1.0]) for i in range(20)], "chunk_id long, content string, source string, tags array<string>, metadata string, embedding array<double>")
    queries = spark.createDataFrame([(q, "some words", [1.0]) for q in range(6)], "query_id long, query string, embedding array<double>")
    hits = spark.createDataFrame([(q, c, 0.5, 2, "vector", c + 1) for q in range(6) for c in range(3)], "query_id long, chunk_id long, distance double, lexical_score int, path string, ordinal int")
    got = search.reranked(hits, chunks, queries)
    plan = search._ranked(hits, chunks, queries, None, None)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert plan.count("lower(content") == below.count("lower(content") > 0 and plan.count("regexp") == below.count("regexp") > 0
    assert "LeftSemi" in below and "content" not in plan[: plan.index("RepartitionByExpression")]
    # Both words in the text, one in the heading, two hits, less distance and length.
    assert {(r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in got.collect()} == {(q, c + 1, c, round(10 + 8 + 12 - 0.125 - len(f"# words of {c}\nand more of some words") / 6000, 6)) for q in range(6) for c in range(3)}


def test_all_terms_of_an_item(spark, tmp_path):
    """An item's eleventh and later terms count, too."""
    words = " ".join(f"filler{i}" for i in range(30)) + " needle"
    put = lambda name, names, rows: pq.write_table(pa.table([pa.array(c) for c in zip(*rows)], names), tmp_path / f"{name}.parquet")
    put("documents", ["doc_id", "text", "lang", "source"], [(1, "a needle in hay", "en", "s"), (2, "filler29 alone", "en", "s"), (3, "hay", "en", "s"), (4, "needle and filler1", "en", "filler7")])
    put("benchmark", ["item_id", "text"], [(7, words), (50, "hay")])
    put("embeddings", ["vec_id", "embedding"], [(7, [1.0]), (50, [2.0])])
    columns, want = by_sql(tmp_path, "q_lexical_score_all")
    assert by_spark(spark, tmp_path, "q_lexical_score_all", columns) == want
    assert dict(zip(columns, range(3))) == {"query_id": 0, "chunk_id": 1, "lexical_score": 2}
    assert set(want) == {(7, 1, 2), (7, 2, 4), (7, 4, 9), (50, 1, 2), (50, 3, 2)}


def test_packed_hits_of_every_item(spark, tables):
    """The hits of each item, cut and passed over as the budget has it, against plain Python."""
    chunks, items = catalogue.chunk_table(reader(spark, tables)), catalogue.item_table(reader(spark, tables))
    ranked = search.reranked(search.hybrid(chunks, items), chunks, items).where("rank <= 20").orderBy("query_id", "rank").collect()
    want, used = set(), Counter()
    for r in ranked:
        left = 12000 - used[r.query_id]
        cut = len(r.content) > left
        if not cut or left >= 500:
            size = len(r.content[: max(left, 0)].rstrip() + context.TRUNCATED) if cut else len(r.content)
            used[r.query_id] += size
            want.add((r.query_id, r["rank"], r.chunk_id, cut, size))
    got = QUERIES["q_pack_truncate"](spark, tables).collect()
    assert {(r.query_id, r.ordinal, r.chunk_id, r.truncated, r.n_chars) for r in got} == want
    assert {r.query_id for r in got} == {1, 3, 50, 51, 52} and any(r.truncated for r in got)


def test_gate_decides_on_every_item(spark, tables):
    got = {r.query_id: r for r in QUERIES["q_relevance_gate"](spark, tables).collect()}
    assert sorted(got) == [1, 3, 50, 51, 52]
    # Item 3 has no vector: its hits are by words, so they have no distance to score them by. Item 51's words are in no document.
    assert got[3].used and (got[3].top_score, got[3].before) == (0.35, 5)
    assert not got[51].used and got[51].overlap == 0.0 and not got[52].used and got[52].before == 5
    assert got[1].used and got[1].top_score > 0.35


def test_fused_contexts_of_every_item(spark, tables):
    got = QUERIES["q_hybrid_context_fused"](spark, tables).collect()
    assert {r.query_id for r in got} == {1, 3, 50, 51, 52}


def test_whole_graph_search_like_plain_search(spark):
    """More entities than 20 and more edges than 6 n: the best of all of them, names of several spellings and edges listed twice among them."""
    r = random.Random(6)
    names = [f"bolt s{i}" for i in range(40)] + ["Bolt S1", "bolt", "ring bolt", "RING bolt", "old ring"]
    rows = [(r.choice(names), r.choice(["uses", "provides", "likes", "is_a", "has"]), r.choice(names), [f"d{k}" for k in range(r.randrange(0, 8))]) for _ in range(500)]
    rows += [("hub bolt", "has", f"spoke {i:03}", []) for i in range(90)] + [("hub bolt", "depends_on", "zz", ["a"] * 6)]
    edges = list({x[:3]: x for x in rows}.values())
    asked = [(1, ["bolt"]), (2, ["ring"]), (3, ["hub", "old"]), (4, ["S1 ring"]), (5, ["nothing"]), (6, ["BOLT"])]
    split = lambda x: [w for w in re.split("[^a-z0-9]+", x.lower()) if w]
    every = {e for s, _, t, _ in edges for e in (s, t)}
    mean = sum(len(split(e)) for e in every) / len(every)
    df = Counter(w for e in every for w in set(split(e)))
    want = {}
    for q, terms in asked:
        words = {w for t in terms for w in split(t)}
        points = {e: round(sum(math.log(1 + (len(every) - df[w] + 0.5) / (df[w] + 0.5)) * split(e).count(w) * 2.2 / (split(e).count(w) + 1.2 * (0.25 + 0.75 * len(split(e)) / mean)) for w in words if w in split(e)), 6) for e in every if words & set(split(e))}
        scored = [(-round(0.5 * min(max(points.get(s, 0), points.get(t, 0)) / 4, 1) + 0.3 * V.RELATION_PRIORITY[rel] / 80 + 0.2 * min(len(ds) / 5, 1), 4), (s, rel, t)) for s, rel, t, ds in edges if rel in V.RELATION_PRIORITY and (s in points or t in points)]
        pairs = {}
        for x in sorted(scored):
            pairs.setdefault((x[1][0].lower(), x[1][2].lower()), x)
        want |= {(q, k + 1): (*x[1], round(-x[0], 4)) for k, x in enumerate(sorted(pairs.values())[:4])}
    table, queries = spark.createDataFrame(edges + edges[:5], "source string, relation string, target string, sources array<string>"), spark.createDataFrame(asked, "query_id long, terms array<string>")
    got = {(x.query_id, x["rank"]): (x.source, x.relation, x.target, round(x.graph_score, 4)) for x in graph.scored_search(table, queries, 4, whole=True).dropDuplicates(["query_id", "rank"]).collect()}
    assert got == want and len(want) == 20
    part = {(x.query_id, x["rank"]): (x.source, x.relation, x.target, round(x.graph_score, 4)) for x in graph.scored_search(table, queries, 4).dropDuplicates(["query_id", "rank"]).collect()}
    assert part != want and got[3, 1][2] == "zz"


def test_fused_evidence_beyond_the_first_chunks(spark):
    """What tells of a relation is the 601st chunk of its document; it is evidence."""
    chunks = [(i, f"hay of number {i} in plenty of words to read here", "wiki/far.md", [], "{}", None) for i in range(600)]
    chunks += [(600, "Docker runs on Linux, as this chunk of many words says", "wiki/far.md", [], "{}", None), (900, "Everything that Docker is, in some plain words to read", "wiki/near.md", [], "{}", [0.0])]
    chunks = spark.createDataFrame(chunks, "chunk_id long, content string, source string, tags array<string>, metadata string, embedding array<double>")
    queries = spark.createDataFrame([(1, "everything Docker is", [0.0])], "query_id long, query string, embedding array<double>")
    edges = spark.createDataFrame([("Docker", "runs_on", "Linux", ["wiki/far.md"])], "source string, relation string, target string, sources array<string>")
    told = lambda **k: {(r.type, r.source) for r in pipelines.hybrid_context_fused(chunks, queries, edges, n_vector=1, **k)[0].collect()}
    assert ("graph_evidence", "wiki/far.md") not in told() and ("graph_evidence", "wiki/far.md") in told(whole=True)
