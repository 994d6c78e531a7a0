"""Operators on small fixtures: gate, fusion, packing, graph, conversations, web, ingest, streaming, sources."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, context, conversations, fusion, gate, graph, ingest, search, telemetry, web
from quern.sources import files
from quern.sources.tables import VersionedTable
from quern.streaming.ingest import document_stream, ingest_stream

ITEM = "query_id long, ordinal int, type string, content string, source string, distance double"


@pytest.mark.parametrize(
    "query, items, used, reason, score",
    [
        ("jak działa Docker", [(1, 1, "vector", "Docker uruchamia kontenery.", "docker.md", 0.35)], True, "relevant", None),
        ("ile się rozkłada kupa psa", [(1, 1, "vector", "Terraform zapisuje stan.", "tf.md", 0.2)], False, "low_lexical_overlap", 0.4977),
        ("jaki jest przepis na sernik", [], False, "empty_results", 0.0),
        ("jak działa OpenShift ingress", [(1, 1, "graph", "OpenShift --uses--> Ingress", "knowledge_graph", None)], False, "graph_only_without_evidence", None),
        ("co to jest Terraform remote state", [(1, 1, "vector", "Co to jest: Terraform remote state opisuje stan.", "tf.md", 0.4)], True, "relevant", 0.9954),
        ("kto wygrał mecz", [(1, 1, "vector", "mecz", "a.md", 0.1)], False, "current_query_without_current_source", None),
    ],
)
def test_gate(spark, query, items, used, reason, score):
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    d, judged = gate.decided(queries, spark.createDataFrame(items, ITEM))
    row = d.first()
    assert (row.used, row.reason) == (used, reason)
    assert row.after == (len(items) if used else 0) and judged.count() == len(items)
    if score is not None:
        assert row.score == score


def test_fusion(spark):
    schema = "query_id long, path string, rank int, content string, source string, type string, score double, traversal string"
    rows = [(1, "vector", 0, "a", "s", "vector", 0.48, None), (2, "graph", 0, "A --uses--> B", "g", "graph", 0.70, "A --uses--> B"), (3, "graph", 0, "A --is_a--> B", "g", "graph", 0.70, None)]
    rows += [(4, p, 0, "x", "s", t, 0.9, None) for p, t in (("vector", "vector"), ("graph", "graph"), ("evidence", "graph_evidence"))]
    rows += [(5, "vector", 0, "x", "s", "vector", 0.1, None), (5, "vector", 1, "x", "s", "vector", 0.2, None)]
    got = {r.query_id: r for r in fusion.fused(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].fused_score for i in (1, 2, 3, 4)] == [0.555, 0.64, 0.325, 1.0]
    assert got[4].reason == "multi_path(vector|graph|evidence)" and got[2].reason == "graph_primary"
    assert got[5].vector_score == 0.2 and got[5].rank_vector == 0 and abs(got[5].rrf - 0.5 * (1 / 61 + 1 / 62)) < 1e-12


def test_packing(spark):
    schema = "query_id long, ordinal int, type string, content string"
    rows = [(1, 1, "vector", "a" * 1501), (1, 2, "vector", "b" * 600), (1, 3, "graph", "g" * 10), (1, 4, "vector", "c" * 400), (2, 1, "vector", "a" * 1500), (2, 2, "vector", "b" * 600), (2, 3, "graph", "g" * 10)]
    got = context.packed(spark.createDataFrame(rows, schema), 2000, 500).orderBy("query_id", "ordinal").collect()
    assert [(r.query_id, r.ordinal, r.truncated, len(r.content)) for r in got] == [(1, 1, False, 1501), (1, 3, False, 10), (1, 4, False, 400), (2, 1, False, 1500), (2, 2, True, 512), (2, 3, False, 10)]
    assert context.prefix(spark.createDataFrame(rows, schema), 2000).count() == 2


def test_graph(spark):
    edges = spark.createDataFrame([("A", "uses", "B", ["x"]), ("A", "depends_on", "B", ["y"]), ("C", "zz", "D", ["x", "y"]), ("C", "yy", "D", ["x"])], "source string, relation string, target string, sources array<string>")
    up = graph.upserted(edges, spark.createDataFrame([("A", "uses", "B", "x"), ("A", "uses", "B", "z"), ("E", "has", "F", "")], "source string, relation string, target string, document string"))
    got = {(r.source, r.relation, r.target): (r.sources, r.created) for r in up.collect()}
    assert got[("A", "uses", "B")] == (["x", "z"], False) and got[("E", "has", "F")] == ([], True) and len(got) == 5
    best = {r.source: (r.relation, r.sources, r.merged_count) for r in graph.resolved(edges).collect()}
    assert best == {"A": ("depends_on", ["x", "y"], 2), "C": ("zz", ["x", "y"], 2)}
    assert {(r.source, r.relation) for r in graph.conflicts(edges).where("winner").collect()} == {("A", "depends_on"), ("C", "zz")}
    raw = spark.createDataFrame([("k8s", "used by", "neo4j", ["d"]), ("Kubernetes", "uses", "Neo4j", ["e"]), ("pods", "uses", "Neo4j", ["e"]), ("Neo4j", "uses", "neo4j", [])], edges.schema)
    assert [(r.source, r.relation, r.target, r.sources) for r in graph.cleaned(raw).collect()] == [("Kubernetes", "uses", "Neo4j", ["d", "e"])]
    assert {r.action: r.n for r in graph.classified(raw).groupBy("action").agg(F.count("*").alias("n")).collect()} == {"rewrite": 1, "keep": 1, "delete": 2}
    queries = spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>")
    assert [(r.relation, r.score) for r in graph.search(edges, queries).collect()] == [("depends_on", 12)]


def test_search_wildcards_and_union(spark):
    chunks = spark.createDataFrame([(1, "one a-b two", "s", ["t"], "{}", [0.0, 1.0]), (2, "nothing", "s", ["t"], "{}", [1.0, 0.0]), (3, "nothing", "s", ["t"], "{}", [5.0, 0.0])], "chunk_id long, content string, source string, tags array<string>, metadata string, embedding array<float>")
    queries = spark.createDataFrame([(1, "a_b nothing", [0.0, 1.0])], "query_id long, query string, embedding array<float>")
    assert {(r.chunk_id, r.lexical_score) for r in search.lexical_scores(chunks, queries).collect()} == {(1, 2), (2, 2), (3, 2)}
    hits = search.hybrid(chunks, queries, 2)
    assert [(r.chunk_id, r.path) for r in hits.orderBy("ordinal").collect()] == [(1, "vector"), (2, "vector")]
    assert search.reranked(hits, chunks, queries).count() == 2


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "system", "s"), (1, 2, "assistant", "a"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2")], "conv_id long, turn long, role string, text string")
    assert [r.question for r in conversations.pairs(turns).collect()] == ["q2"]
    assert [r.question for r in conversations.pairs(turns, True).orderBy("turn").collect()] == ["q", "q2"]
    qa = spark.createDataFrame([(1, 0, "how do I list pods in kubernetes today", "use kubectl get pods -n namespace to list them all; then filter"), (1, 1, "short", "x"), (1, 2, "what is the best film of the last year?", "I think it was the one about the two friends on a very long trip by the sea")], "conv_id long, turn long, question string, answer string")
    assert [(r.decision, r.reason) for r in conversations.classified(qa).orderBy("turn").collect()] == [("keep", "quick_technical_match"), ("reject", "too_short"), ("reject", "quick_non_technical_match")]


def test_web(spark):
    body = "word " * 80
    title, text, links = web.page(f"<title>T</title><nav>menu</nav>after<div class='stock-toc'>gone</div><article><p>{body}</p><a href='/x#y'>go on</a></article>", "https://ex.com/a/")
    assert title == "T" and "menu" not in text and "gone" not in text and links == ["https://ex.com/x#y"]
    assert web.page(f"<nav><br>menu</nav><p>{body}</p>", "https://ex.com/")[1] == ""  # a void tag in a skipped part counts as nested
    rows = [(1, "https://ex.com/a/", f"<article>{body}<a href='b'>bbb</a><a href='/other'>c</a></article>"), (2, "https://ex.com/a/b", f"<article>{body}</article>"), (3, "https://ex.com/other", body)]
    pages = web.read(spark.createDataFrame(rows, "page_id long, url string, html string"))
    seen = web.crawled(pages, "https://ex.com/a/").orderBy("visit").collect()
    assert [(r.at, r.depth, r.visit, r.found) for r in seen] == [("https://ex.com/a", 0, 0, True), ("https://ex.com/a/b", 1, 1, True)]


def test_crawl_goes_to_the_end_in_order(spark):
    """A chain of 30 pages, which link back and out of scope; short pages and missing ones are visits too."""
    page = lambda i: f"<article>{'word ' * (80 if i != 3 else 2)}<a href='p{i + 1}'>a</a><a href='p{i - 1}'>b</a><a href='/other'>c</a></article>"
    rows = [(i, f"https://ex.com/a/p{i}/", page(i).replace("href='p", "href='/a/p")) for i in range(30)]
    pages = web.read(spark.createDataFrame([*rows, (99, "https://ex.com/a/", "<a href='/a/p0'>x</a>")], "page_id long, url string, html string")).cache()
    got, totals = web.crawled_pages(pages, "https://ex.com/a/", 100)
    assert [r.url for r in got.collect()] == [f"https://ex.com/a/p{i}/" for i in range(30) if i != 3]
    assert totals.first().asDict() == {"visited": 33, "kept": 29, "skipped": 2, "errors": 2}
    few, totals = web.crawled_pages(pages, "https://ex.com/a/", 6)
    assert totals.first().visited == 6 and few.count() == 3


def test_website_import(spark):
    found = spark.createDataFrame([("https://a/1", "One", "x"), ("https://a/2", "Two", "y")], "url string, title string, text string")
    chunks = spark.createDataFrame([("https://a/1", "old"), ("https://a/1", "older"), ("b", "c")], "source string, content string")
    docs, kept, totals = web.imported(found, chunks)
    assert [tuple(r) for r in docs.collect()] == [("https://a/2", "# Two\n\nSource: https://a/2\n\ny")] and kept.count() == 3
    assert tuple(totals.first()) == (2, 1, 1, 0)
    docs, kept, totals = web.imported(found, chunks, True)
    assert docs.count() == 2 and [r.source for r in kept.collect()] == ["b"] and tuple(totals.first()) == (2, 2, 0, 2)


def test_code_blocks():
    py = "import os\n\nclass A:\n    def f(self): pass\n\ndef g():\n    return 1\n"
    assert list(chunking.blocks(py, "python")) == [("class A:", "import os\n\nclass A:\n    def f(self): pass"), ("def g():", "def g():\n    return 1")]
    assert list(chunking.blocks("x = 1", "python")) == [(None, "x = 1")]
    assert list(chunking.blocks("kind: Pod\nmetadata:\n  name: a-b\n---\n---\nx: 1", "yaml")) == [("Pod a-b", "kind: Pod\nmetadata:\n  name: a-b"), ("YAML document 3", "x: 1")]
    assert list(chunking.blocks("SELECT 1;\n\nSELECT\n 2", "sql")) == [("SQL statement 1: SELECT 1;", "SELECT 1;"), ("SQL statement 2: SELECT", "SELECT\n 2")]


def test_repository_rules(spark):
    rels = ["Dockerfile", "README", "README.md", "src/a.py", "docs/x.json", "x.json", "design.txt", "deploy/.env", "charts/v.yaml", "a.rsc"]
    rows = spark.createDataFrame([(r,) for r in rels], "rel string").select("rel", files.for_graph(F.col("rel")).alias("g"), files.graph_text(F.lit("c"), F.col("rel"), F.lit("T")).alias("t")).collect()
    assert {r.rel for r in rows if r.g} == set(rels) - {"src/a.py", "x.json", "deploy/.env"}
    text = {r.rel: r.t for r in rows}
    assert text["README.md"].startswith("# c README\n\nRepository: c\nPath: README.md\n\nT") and text["docs/x.json"].startswith("# x\n") and text["src/a.py"].startswith("# a\n")


def test_aliases_reach_the_search(spark):
    chunks = spark.createDataFrame([(1, "the engine room", "s", ["t"], "{}", None)], "chunk_id long, content string, source string, tags array<string>, metadata string, embedding array<double>")
    queries = spark.createDataFrame([(1, "motor 100%")], "query_id long, query string")
    assert search.lexical_scores(chunks, queries).count() == 0
    assert search.lexical_scores(chunks, queries, aliases={"motor": ("motor", "engine")}).first().lexical_score == 2


def test_relations_extracted(spark):
    docs = spark.createDataFrame([("d1", "Kubernetes uses Neo4j here."), ("d2", "nothing")], "source string, text string")
    triples = spark.createDataFrame([("d1", "k8s", "used by", "neo4j"), ("d1", "k8s", "uses", "Ceph"), ("d2", "a", "zz", "b"), ("d1", "Kubernetes", "uses", "Neo4j")], "document string, source string, relation string, target string")
    found, counters = graph.extracted(docs, triples)
    assert [tuple(r) for r in found.collect()] == [("Kubernetes", "uses", "Neo4j", "d1")]
    assert {r.document: (r.valid, r.rejected) for r in counters.collect()} == {"d1": (2, 1), "d2": (0, 1)}


def test_qa_import(spark):
    q, a = "how do I list the pods in kubernetes today", "use kubectl get pods -n namespace to list them all; then filter by name"
    qa = spark.createDataFrame([(1, 0, q, a), (1, 1, "short", a), (1, 2, "what is the best thing to see in town", "it depends on what you like, but do walk along the river side")], "conv_id long, turn long, question string, answer string")
    assert sorted(r.turn for r in conversations.imported(qa).collect()) == [0, 2]
    assert [r.turn for r in conversations.imported(qa, True).collect()] == [0]


def test_ingest_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "Some text that is long enough. #Tag"), ("b.md", "some  TEXT that is long enough. #tag"), ("c.md", "short")], "source string, text string")
    fresh, counts = ingest.ingested(docs)
    assert [(r.source, r.tags) for r in fresh.collect()] == [("a.md", ["tag"])]
    assert {r.source: (r.valid, r.invalid, r.inserted, r.duplicates) for r in counts.collect()} == {"a.md": (1, 0, 1, 0), "b.md": (1, 0, 0, 1), "c.md": (0, 1, 0, 0)}
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = ingest_stream(document_stream(spark, str(tmp_path / "in"), "source string, text string"), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
        docs.withColumn("source", F.concat("source", F.lit("2"))).write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for name, text in (("x.md", "hello"), ("index.md", "no"), ("CONFIG.md", "no"), ("a.py", "def f(): pass")):
        (tmp_path / "n" / name).write_text(text)
    assert [r.source for r in files.folder(spark, str(tmp_path / "n")).collect()] == ["x.md"]
    assert {r.source for r in files.repository(spark, f"file:{tmp_path}/n", "c").collect()} == {"repo:c:CONFIG.md", "repo:c:a.py", "repo:c:index.md", "repo:c:x.md"}
    (tmp_path / "t.jsonl").write_text(json.dumps({"ts": 1, "elapsed_ms": 5}) + "\nnot json\n")
    assert files.telemetry(spark, str(tmp_path / "t.jsonl")).count() == 1
    table = VersionedTable(spark, str(tmp_path / "v"))
    assert table.read() is None
    table.replace(spark.range(3))
    table.replace(table.read().where("id > 0"))
    assert table.read().count() == 2


def test_golden(spark):
    tests = spark.createDataFrame([(1, ["A.md"], ["vector"]), (2, ["b"], ["graph"])], "query_id long, expected_sources array<string>, expected_types array<string>")
    results = spark.createDataFrame([(1, "x/a.md", "vector"), (2, "b.md", "vector")], "query_id long, source string, type string")
    judged = telemetry.golden(tests, results)
    assert {r.query_id: (r.passed, r.missing) for r in judged.collect()} == {1: (True, []), 2: (False, ["graph"])}
    assert telemetry.pass_counts(judged).first() == (2, 1, 1)


def test_chunks_without_a_vector_are_found(spark):
    rows = [(1, "alpha beta", [0.0, 1.0]), (2, "alpha gamma", [5.0, 5.0]), (3, "alpha delta", None), (4, "nothing", [9.0, 9.0])]
    chunks = spark.createDataFrame([(i, c, "s", ["en"], "{}", e) for i, c, e in rows], "chunk_id long, content string, source string, tags array<string>, metadata string, embedding array<double>")
    queries = spark.createDataFrame([(7, "alpha", [0.0, 0.0])], "query_id long, query string, embedding array<double>")
    got = [(r.chunk_id, r.path, r.distance is None) for r in search.hybrid(chunks, queries, 1).orderBy("ordinal").collect()]
    assert got == [(1, "vector", False), (2, "lexical", False), (3, "lexical", True)]


def test_evidence_beyond_the_first_chunks(spark):
    chunks = spark.createDataFrame([(i, "the needle" if i == 600 else "hay", f"s{i % 2}") for i in range(700)], "chunk_id long, content string, source string")
    wanted = spark.createDataFrame([(1, "s0", ["needle"]), (1, "s1", ["needle"])], "query_id long, source string, terms array<string>")
    assert search.evidence(chunks, wanted).count() == 0
    assert [(r.chunk_id, r.hits, r.rank) for r in search.evidence(chunks, wanted, most=None).collect()] == [(600, 1, 1)]


def test_pages_read_anew_need_no_join(spark, tmp_path):
    """When reindexing, the documents come from the pages alone; stored chunks are only counted."""
    rows = [("https://a/1", "One", "x"), ("https://a/2", "Two", "y"), (None, "None", "z")]
    spark.createDataFrame(rows, "url string, title string, text string").write.parquet(str(tmp_path / "found"))
    spark.createDataFrame([("https://a/1", "old"), ("https://a/1", "older"), ("b", "c"), (None, "n")], "source string, content string").write.parquet(str(tmp_path / "chunks"))
    found, chunks = spark.read.parquet(str(tmp_path / "found")), spark.read.parquet(str(tmp_path / "chunks"))
    docs, kept, totals = web.imported(found, chunks, True)
    assert set(docs.inputFiles()) == set(found.inputFiles()) and docs.count() == 3
    assert kept.count() == 2 and tuple(totals.first()) == (3, 3, 0, 2)
    docs, kept, totals = web.imported(found, chunks)
    assert docs.count() == 2 and kept.count() == 4 and tuple(totals.first()) == (3, 2, 1, 0)
