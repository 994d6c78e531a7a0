"""Model steps with stand-ins: what is asked, how often, and what becomes of replies that can't be read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quern.operators import conversations, graph, models


def logged(folder, reply):
    """A model that leaves a file for each call."""

    def generate(prompt):
        with open(f"{folder}/{os.urandom(8).hex()}", "w") as f:
            f.write(prompt)
        return reply(prompt)

    return generate


def test_replies():
    assert models.in_reply('so: [1, {"a": [2]}] done', list) == [1, {"a": [2]}] and models.in_reply("none", list) is None
    assert models.in_reply('x {"a": 1} y', dict) == {"a": 1} and models.in_reply("{broken}", dict) is None and models.in_reply(None, dict) is None
    assert models.indices("[0, 2, 9, -1, 'x', True] [3]", 4) == [0, 2, 3] and models.indices("[1, oops]", 4) == [] and models.indices("no", 4) == []
    assert models.tags(["#Docker ", "", None, 3], 10) == ["docker", "none", "3"] and models.tags("docker", 10) == []


def test_pairs_in_batches_and_memo(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def reply(prompt):
        items = json.loads(prompt[len(models.PAIRS_PROMPT) :])
        return json.dumps([{"id": str(x["id"]), "keep": "good" in x["question"], "tags": ["#K8S"], "reason": "r"} for x in items if "left out" not in x["question"]] + ["noise", {"id": None}])

    rows = [(i, 0, f"good question {i % 20}" if i % 2 else f"question {i % 20}", "answer") for i in range(60)] + [(99, 0, "left out", None)]
    qa = spark.createDataFrame(rows, "conv_id long, turn long, question string, answer string").repartition(1)
    memo = models.Memo(spark, str(tmp_path / "memo"))
    got = models.pairs_decided(qa, logged(calls, reply), memo).collect()
    assert len(got) == 61 and {(r.keep, tuple(r.told), r.why) for r in got if r.conv_id < 60} == {(True, ("k8s",), "r"), (False, ("k8s",), "r")}
    assert [(r.keep, r.why) for r in got if r.conv_id == 99] == [(False, "missing_llm_batch_decision")]
    asked = [x for f in calls.iterdir() for x in json.loads(f.read_text()[len(models.PAIRS_PROMPT) :])]
    assert len(asked) == 21 and all(len(json.loads(f.read_text()[len(models.PAIRS_PROMPT) :])) <= 12 for f in calls.iterdir())
    before = len(list(calls.iterdir()))
    more = qa.unionByName(spark.createDataFrame([(100, 0, "good new one", "a")], qa.schema))
    again = models.pairs_decided(more, logged(calls, reply), memo).collect()
    assert len(again) == 62 and len(list(calls.iterdir())) == before + 1


def test_failures_give_the_default_and_are_not_kept(spark, tmp_path):
    def broken(prompt):
        if "bad" in prompt:
            raise RuntimeError("no model")
        return "no json" if "odd" in prompt else '{"tags": ["A", "b"], "reason": null}'

    queries = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "odd"), (4, None)], "query_id long, query string")
    memo = models.Memo(spark, str(tmp_path / "memo"))
    got = {r.query_id: (r.told, r.why) for r in models.queries_tagged(queries, broken, memo).collect()}
    assert got == {1: (["a", "b"], ""), 2: ([], "failed_to_parse_llm_response"), 3: ([], "failed_to_parse_llm_response"), 4: (["a", "b"], "")}
    assert memo.table("queries").read().count() == 2
    well = {r.query_id: r.told for r in models.queries_tagged(queries, lambda p: '{"tags": ["z"]}', memo).collect()}
    assert well == {1: ["a", "b"], 2: ["z"], 3: ["z"], 4: ["a", "b"]}
    assert models.queries_tagged(queries.where("false"), broken).count() == 0


def test_rewriting_and_documents(spark):
    queries = spark.createDataFrame([(1, "jak"), (2, "co")], "query_id long, query string")
    got = models.rewritten(queries, lambda p: '{"query": " how "}' if p.endswith("jak") else '{"query": ""}').collect()
    assert {r.query_id: r.wording for r in got} == {1: "how", 2: "co"}
    docs = spark.createDataFrame([("a.md", "x" * 9000)], "source string, text string")
    assert models.documents_tagged(docs, lambda p: json.dumps({"tags": [str(p.count("x")), p.split("\n")[2][:10]]})).first().told == ["6000", "name: a.md"]


def test_rerank(spark):
    hits = spark.createDataFrame([(q, i, f"p{i}") for q in (1, 2, 3) for i in range(1, 9)], "query_id long, ordinal int, content string")
    queries = spark.createDataFrame([(1, "named"), (2, "none"), (3, "broken")], "query_id long, query string")

    def generate(prompt):
        if "broken" in prompt:
            raise ValueError
        return "[7, 1, 50, -1, 1]" if "named" in prompt else "[]"

    rows = models.model_reranked(hits, queries, generate, n=4).collect()
    got = {q: [r.content for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] for q in (1, 2, 3)}
    assert got == {1: ["p8", "p2", "p8", "p2"], 2: ["p1", "p2", "p3", "p4"], 3: ["p1", "p2", "p3", "p4"]}


def test_smart_import(spark):
    q, a = "how do I list the pods in kubernetes today", "use kubectl get pods -n namespace to list them all; then filter by name"
    open_q = "what does a deployment do in general terms please"
    rows = [(1, 0, q, a), (1, 1, open_q, "it keeps a number of copies of one thing running and replaces what stops")]
    qa = spark.createDataFrame(rows, "conv_id long, turn long, question string, answer string")
    said = models.pairs_decided(conversations.cleaned(qa), lambda p: '[{"id": 0, "keep": true, "tags": ["x"]}, {"id": 1, "keep": true, "tags": ["x"]}]')
    decisions = said.select("conv_id", "turn", "keep", "told")
    got = {r.turn: r.tags for r in conversations.imported(qa, True, decisions).collect()}
    assert set(got) == {0, 1} and "x" in got[1] and "x" not in got[0]


TRIPLES = "array<struct<source:string,relation:string,target:string>>"


def test_change_set_and_second_run(spark):
    docs = spark.createDataFrame(
        [
            (1, "a.md", "# Red Rod\n\nkubernetes uses neo4j here", [("k8s", "used by", "neo4j"), ("Kubernetes", "uses", "Neo4j"), ("k8s", "uses", "Ceph"), ("x", "zz", "y"), (None, None, None)]),
            (2, "b.md", "# Red Rod\n\nkubernetes uses neo4j too", [("Kubernetes", "uses", "Neo4j")]),
            (3, "c.md", None, None),
        ],
        f"doc_id long, source string, text string, triples {TRIPLES}",
    )
    edges = spark.createDataFrame([("Red Rod", "is_a", "dokument", ["old"])], "source string, relation string, target string, sources array<string>")
    changes, counters = graph.change_set(docs, edges)
    got = {(r.doc_id, r.source, r.relation, r.target): r.state for r in changes.collect()}
    assert got[1, "Kubernetes", "uses", "Neo4j"] == "created" and got[2, "Kubernetes", "uses", "Neo4j"] == "existing" and got[1, "Red Rod", "is_a", "dokument"] == "existing"
    n = {r.doc_id: r for r in counters.collect()}
    assert n[1].n_skipped == 3 and n[2].n_skipped == 0 and all(r.n_created + r.n_existing == r.n_unique for r in n.values()) and n[1].n_valid == n[1].n_unique + 1
    known, after = graph.merged(graph.provenance(edges), changes)
    merged = {(r.source, r.relation, r.target): (r.source_count, r.created) for r in after.collect()}
    assert merged["Kubernetes", "uses", "Neo4j"] == (2, True) and merged["Red Rod", "is_a", "dokument"] == (3, False)
    again, second = graph.change_set(docs, after)
    assert {r.state for r in again.collect()} == {"existing"}
    assert [(r.n_valid, r.n_unique, r.n_created) for r in second.orderBy("doc_id").collect()] == [(n[i].n_valid, n[i].n_unique, 0) for i in (1, 2, 3)]
    assert graph.merged(known, again)[0].count() == known.count()


@pytest.mark.parametrize("document", ["d", None, " "])
def test_provenance_rows(spark, document):
    edges = spark.createDataFrame([("A", "uses", "B", ["d", "e"]), ("A", "has", "B", [])], "source string, relation string, target string, sources array<string>")
    triples = spark.createDataFrame([("A", "has", "B", document)] * 2, "source string, relation string, target string, document string")
    rows, after = graph.merged(graph.provenance(edges), triples)
    assert {r.relation: (r.source_count, r.created) for r in after.collect()} == {"uses": (2, False), "has": (1 if document == "d" else 0, False)}
    one = graph.resolved_pairs(rows).first()
    assert (one.merged_types, one.merged_count, one.source_count) == (["has", "uses"], 2, 2)


def test_few_items_are_held_at_once(spark):
    """Of a batch of many items, a task holds as Python objects those of one call."""

    def ask(items):
        import gc

        return [{"n": sum(isinstance(x, dict) and "passages" in x and "query" in x for x in gc.get_objects())} for _ in items]

    rows = spark.range(300).select(F.col("id").cast("string").alias("query"), F.array(F.col("id").cast("string")).alias("passages")).coalesce(1)
    got = models.called(rows, ["query", "passages"], ask, "n int", {"n": -1}, "held", 4)
    assert got.count() == 300 and 0 < got.agg(F.max("n")).first()[0] < 20


def test_whole_texts_need_no_join(spark):
    """Anchors are read from whole texts, triples from what the model was shown; nothing after the model's step carries whole texts."""
    shown = "# Red Rod\n\nkubernetes uses neo4j here " + "word " * 1700
    texts = spark.createDataFrame([(1, "a.md", shown + "\n## Blue Box\n"), (2, "b.md", shown + "\n## Green Gate\n"), (3, "c.md", None)], "doc_id long, source string, text string")
    edges = spark.createDataFrame([("Red Rod", "contains", "Blue Box")], "source string, relation string, target string")
    model = lambda p: '[{"source": "k8s", "relation": "uses", "target": "neo4j"}, {"source": "k8s", "relation": "uses", "target": "green gate"}]' if "kubernetes" in p else "none"
    read = models.with_triples(models.sampled(texts), model)
    assert read.agg(F.max(F.length("text"))).first()[0] == models.TRIPLES
    got = [graph.change_set(docs, edges, whole=whole) for docs, whole in ((read, texts), (models.with_triples(texts, model), None))]
    (changes, counters), (old_changes, old_counters) = ([sorted(map(tuple, x.collect())) for x in y] for y in got)
    assert (changes, counters) == (old_changes, old_counters) and len(counters) == 3
    states = {(x[0], *x[2:5]): x[5] for x in changes}
    assert states[1, "Red Rod", "contains", "Blue Box"] == "existing" and states[2, "Red Rod", "contains", "Green Gate"] == "created"
    assert {x[0]: x[-1] for x in counters} == {1: 1, 2: 1, 3: 0}


def test_answers_go_on_together(spark):
    """The answers of many calls are one batch for Spark, and all of them arrive."""
    n = 2 * models.CALLS + 5
    rows = spark.range(n).select(F.col("id").cast("string").alias("query")).coalesce(1)
    got = models.called(rows, ["query"], lambda items: [{"n": int(x["query"])} if int(x["query"]) % 3 else None for x in items], "n int", {"n": -1}, "many")
    assert {int(r.query): r.n for r in got.collect()} == {i: i if i % 3 else -1 for i in range(n)}
