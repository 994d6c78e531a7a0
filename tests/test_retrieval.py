"""Retrieval as a whole, its settings and records; lookup of items in texts, graph cleanup and site import against plain Python."""

import json
import random
from collections import Counter

import pytest

from quern import vocabulary as V
from quern.operators import graph, models, telemetry
from quern.plans import pipelines
from quern.settings import Settings, is_on, words

CHUNKS = "chunk_id long, content string, source string, tags array<string>, metadata string, embedding array<float>"
QUERIES = "query_id long, query string, embedding array<float>"
EDGES = "source string, relation string, target string, sources array<string>"


def test_settings(spark):
    names = {"gate": " Off ", "threshold": "0.6", "least_results": "many", "n_graph": "3"}
    try:
        for k, v in names.items():
            spark.conf.set(f"quern.retrieval.{k}", v)
        got = Settings.of(spark)
    finally:
        for k in names:
            spark.conf.unset(f"quern.retrieval.{k}")
    assert (got.gate, got.threshold, got.least_results, got.n_graph) == (False, 0.6, 1, 3)
    assert Settings.of(spark) == Settings() and got.rules()["threshold"] == 0.6
    assert [is_on(x) for x in ("1", "TRUE", " yes", "on", "0", "", "nonsense")] == [True] * 4 + [False] * 3
    assert words(" a, ,b ,") == ["a", "b"] and words("") is None and words(None) is None and words(",") == []


@pytest.fixture(scope="module")
def corpus(spark):
    about = "Docker runs containers on hosts and keeps images of every container layer number "
    texts = [(i, f"{about}{i} in folder {i % 4} with plenty of words to read", f"wiki/doc{i % 4}.md", ["docker"], "{}", [float(i % 5), 1.0]) for i in range(12)]
    texts += [(50, "Kubernetes uses Docker for pods and deployment of images across many hosts in clusters", "wiki/k8s.md", [], "{}", None), (51, None, None, None, None, None)]
    edges = [("Kubernetes", "uses", "Docker", ["wiki/k8s.md", "wiki/doc1.md"]), ("Docker", "provides", "Containers", ["wiki/doc2.md"]), ("Docker", "likes", "Whales", ["wiki/doc3.md"])]
    asked = [(1, "how does Docker run containers and images", [0.0, 1.0]), (2, "zupa pomidorowa przepis babci", [4.0, 1.0]), (3, "", None)]
    return spark.createDataFrame(texts, CHUNKS).repartition(3), spark.createDataFrame(asked, QUERIES), spark.createDataFrame(edges, EDGES)


@pytest.mark.parametrize("gate, top_k", [(True, None), (True, 2), (False, None), (False, 99)])
def test_retrieved(spark, corpus, gate, top_k):
    s = Settings(gate=gate)
    most = None if top_k is None else min(top_k, 20)
    results, records = pipelines.retrieved(*corpus, settings=s, top_k=top_k)
    got = {r.query_id: r for r in records.collect()}
    items, decisions = pipelines.hybrid_context(*corpus, n_vector=min(s.n_vector, most or 99))
    rows, verdict = items.orderBy("query_id", "ordinal").collect(), {d.query_id: d for d in decisions.collect()}
    assert sorted(got) == [1, 2, 3]
    shown = Counter()
    for q, r in got.items():
        own = [x for x in rows if x.query_id == q]
        kept = [x for x in own if x.accepted or not gate][:most]
        shown[q] = len(kept)
        assert (r.rag_used, r.gate_reason, r.relevance_score) == (verdict[q].used or not gate, verdict[q].reason, verdict[q].score)
        assert (r.results_before_gate, r.accepted_results, r.rejected_results) == (len(own), sum(x.accepted for x in own), sum(not x.accepted for x in own))
        assert r.results_after_gate == len(kept) and dict(r.types) == Counter(x.type for x in kept)
        assert r.sources == list(dict.fromkeys(x.source for x in kept if x.source != "knowledge_graph"))[:20]
        assert r.instruction == (s.context if r.rag_used else s.no_context) and (r.top_k, r.gate_enabled, r.endpoint) == (most, gate, "retrieve")
    assert Counter(x.query_id for x in results.collect()) == +shown and shown[1] > 0
    if gate:
        assert shown[2] == shown[3] == 0 and (top_k or set(got[1].types) == {"vector", "graph", "graph_evidence"})


def test_containing_like_plain_search(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abÄ") for _ in range(r.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(120)] + [(200, None), (201, ""), (5, "ab ab ab"), (None, "ab ab")]
    docs += [(300 + i, "a hot passage that many share, copied") for i in range(80)]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 5)))) for i in range(60)] + [(90, None), (91, ""), (92, "t passage that many sh"), (93, "no such words anywhere here"), (94, "-"), (95, "hot passage that nobody shares, copied")]
    got = telemetry.containing(spark.createDataFrame(items, "item_id long, wanted string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    want = {i: sum(w is not None and t is not None and d is not None and w in t for d, t in docs) for i, w in items}
    assert {x.item_id: x.n_documents for x in got.collect()} == want and want[92] == 80 and want[93] == want[95] == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert {x.n_documents for x in telemetry.containing(spark.createDataFrame(items, "item_id long, wanted string"), empty).collect()} == {0}
    assert telemetry.containing(spark.createDataFrame([], "item_id long, wanted string"), empty).count() == 0


def test_containing_shuffles_when_lists_are_long(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "FEW", 0)
    docs = spark.createDataFrame([(1, "one two three four"), (2, "two three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "e two three f"), (2, "o three"), (3, "one two three")], "item_id long, wanted string")
    assert {x.item_id: x.n_documents for x in telemetry.containing(items, docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_cleanup(spark):
    rows = [("Docker", "uses", "Linux", ["a"]), ("docker", "used by", "linux", ["b"]), ("Lost", "no link", "Other", ["c"]), ("Self", "uses", "self", None), (None, "uses", "Linux", None)]
    nodes = spark.createDataFrame([("Alone",), ("Docker",), (None,)], "name string")
    left, after, totals = graph.cleanup(nodes, spark.createDataFrame(rows, EDGES))
    assert {x.name for x in left.collect()} == {"Docker", "Linux"}
    assert [(x.source, x.relation, x.target, x.sources) for x in after.collect()] == [("Docker", "uses", "Linux", ["a", "b"])]
    # docker, linux, Lost, Other, Self, self and Alone go.
    assert tuple(totals.first()) == (5, 1, 3, 1, 2, 7)
    none = graph.cleanup(nodes.where("false"), spark.createDataFrame([], EDGES))
    assert none[0].count() == none[1].count() == 0 and tuple(none[2].first()) == (0, 0, 0, 0, 0, 0)


def test_fallback_score(spark):
    rows = [("Docker", "uses", "Linux", ["a", "b"]), ("Docker Hub", "has", "Images", ["a"] * 9)]
    asked = spark.createDataFrame([(1, ["Docker", "Linux"]), (2, ["nothing"]), (3, [])], "query_id long, terms array<string>")
    got = {(x.query_id, x.source): x.graph_score for x in graph.fallback_search(spark.createDataFrame(rows, EDGES), asked).collect()}
    score = lambda points, relation, n: round(0.5 * min(points / 20, 1) + 0.3 * V.RELATION_PRIORITY[relation] / 80 + 0.2 * min(n / 5, 1), 4)
    assert got == {(1, "Docker"): score(24, "uses", 2), (1, "Docker Hub"): score(2, "has", 9)}


def test_website_import_with_relations(spark):
    text = "Docker uses Linux on every host, and much more of image layers is told about containers here. " * 3
    found = spark.createDataFrame([("https://a/1", "One", text), ("https://a/2", "Two", text), ("https://a/3", "Three", "")], "url string, title string, text string")
    chunks = spark.createDataFrame([("https://a/1", "x"), ("https://a/1", "y"), ("b", "z")], "source string, hash string")
    edges = spark.createDataFrame([("Docker", "uses", "Linux")], "source string, relation string, target string")
    model = lambda p: json.dumps([{"source": "docker", "relation": "uses", "target": "Linux"}, {"source": "Docker", "relation": "provides", "target": "Image Layers"}]) if "containers" in p else "none"
    new, kept, changes, totals = pipelines.website_import(found, chunks, edges, model)
    t = totals.first()
    assert (t.pages_found, t.pages_imported, t.duplicate_pages, t.deleted_chunks) == (3, 2, 1, 0) and kept.count() == 3
    assert (t.chunks, t.valid + t.invalid, t.valid - t.duplicates) == (2, t.chunks, t.inserted) and new.count() == t.inserted
    states = Counter((x.relation, x.state) for x in changes.collect() if x.target in ("Linux", "Image Layers"))
    assert states[("uses", "existing")] == 1 and states[("provides", "created")] == 1
    all_states = Counter(x.state for x in changes.collect())
    assert (t.graph_created, t.graph_existing) == (all_states["created"], all_states["existing"]) and t.graph_valid >= t.graph_created + t.graph_existing
    again = pipelines.website_import(found, chunks, reindex=True)
    t = again[3].first()
    assert (t.pages_imported, t.deleted_chunks, t.graph_valid) == (3, 2, 0) and again[2] is None and [x.source for x in again[1].collect()] == ["b"]
    assert tuple(pipelines.website_import(found.where("false"), chunks)[3].first()) == (0,) * 12


def test_questions_keep_their_wording(spark):
    """A query that a model can't read keeps its words and gets no tags."""
    asked = spark.createDataFrame([(1, "first"), (2, "second")], "query_id long, query string")
    model = lambda p: '{"query": "Q", "tags": ["#X"], "reason": "r"}' if p.endswith("first") else "broken {"
    told = models.rewritten(models.queries_tagged(asked, model).withColumnRenamed("why", "w"), model)
    assert {x.query_id: (x.wording, x.told) for x in told.collect()} == {1: ("Q", ["x"]), 2: ("second", [])}


def test_graph_search_like_plain_search(spark):
    """Queries of equal terms, names with more edges than stay, edges by both ends, loops and edges listed twice."""
    r = random.Random(5)
    names = ["red bolt", "Red Bolt", "hot bolt", "ring", "bolt", "old Ring", "x"] + [f"S{i}" for i in range(12)]
    rows = [(r.choice(names), r.choice(["uses", "provides", "likes", "is_a"]), r.choice(names), [f"d{k}" for k in range(r.randrange(0, 4))]) for _ in range(400)]
    edges = list({x[:3]: x for x in rows}.values())
    edges += edges[:5]
    lists = [["bolt"], ["BOLT"], ["red bolt", "ring"], ["ring", "red bolt"], ["s1", None], [], None, ["nothing"], ["ring"], ["x", "s"]]
    asked = [(i, lists[i % len(lists)]) for i in range(3 * len(lists))]
    want = {}
    for q, terms in asked:
        score = Counter()
        for s, rel, t, sources in edges if terms and None not in terms else ():
            if rel in V.RELATION_PRIORITY:
                score[s, rel, t, len(sources)] += sum(10 * (e.lower() == x.lower()) + 2 * (x.lower() in e.lower()) for e in (s, t) for x in terms)
        best = sorted(((-n, -e[3], e[:3]) for e, n in score.items() if n))[:100]
        order = lambda x: (x[0], -V.RELATION_PRIORITY[x[2][1]], max(x[1], -10), x[2])
        pairs = {}
        for x in sorted((x for x in best if x[1]), key=order):
            pairs.setdefault((x[2][0].lower(), x[2][2].lower()), x)
        want |= {(q, k + 1): (*x[2], -x[0]) for k, x in enumerate(sorted(pairs.values(), key=order)[:3])}
    table, queries = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, "query_id long, terms array<string>")
    got = {(x.query_id, x["rank"]): (x.source, x.relation, x.target, x.score) for x in graph.search(table, queries, 3).collect()}
    assert got == want and len({q for q, _ in want}) == 18


def test_graph_search_grows_with_different_terms(spark, monkeypatch):
    """Equal queries are searched for once, and a name hands on as many edges as may stay."""
    asked = spark.createDataFrame([(i, ["Bolt"] if i % 2 else ["bolt"]) for i in range(50)], "query_id long, terms array<string>")
    edges = spark.createDataFrame([(f"S{i}", "uses", "bolt", ["d"]) for i in range(300)], EDGES)
    seen, best = [], graph.best_of_pairs
    monkeypatch.setattr(graph, "best_of_pairs", lambda rows, *a: seen.append(rows.count()) or best(rows, *a))
    assert graph.search(edges, asked, 2).count() == 100 and seen == [100]
    words, bm25 = [], graph._bm25
    monkeypatch.setattr(graph, "_bm25", lambda names, queries, *a: words.append(queries.count()) or bm25(names, queries, *a))
    assert graph.bm25(edges.select("source").withColumnRenamed("source", "name").union(edges.select("target")), asked).count() == 50
    assert graph.scored_search(edges, asked, 2).count() == 100 and words == [1, 1]
