"""The pipeline's stages on small tables with odd rows, each against what brute force would keep."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import near_copies, pipeline
from quern.llm import queries as Q
from quern.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(40))
    rows = [(i, text() + (" you moron" if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(200)]
    item = " ".join(text().split()[:20])
    rows += [(300, rows[1][1], "en", "s0", 1), (301, f"{text()} {item} {text()}", "en", "s0", 1), (302, f"{text()} password=b7db7aa4a5fcc78305 {text()}", "en", None, 1)]
    rows += [(303, None, None, None, None), (None, text(), "en", "s1", 1), (305, "", "en", "s1", 0), (306, text(), "en", "s1", 1), (306, text(), "en", "s1", 1)]
    rows += [(307, text(), "en", "s1", 1)] * 2
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).withColumn("__x", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], folder), f"test-{name}"))
    toxic, near, clean, redacted, packed = kept[1:]
    assert [k.columns == docs.columns for k in kept] == [True] * 5 + [False]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert {i for i in ids(docs) if i is not None and i < 200 and i % 4 == 0} & ids(toxic) == set() and 1 in ids(toxic) and 303 in ids(toxic)
    assert 300 in ids(toxic) and 300 not in ids(near) and None in ids(near)
    # Different texts under one id are different documents; equal rows are one.
    assert near.where("doc_id = 306").count() == 2 and near.where("doc_id = 307").count() == 1
    assert ids(near) - ids(clean) == {301}
    assert clean.count() == redacted.count()
    assert "[SECRET]" in redacted.where("doc_id = 302").first().text and redacted.where("text like '%[SECRET]%'").count() == 1
    assert ids(packed) == ids(redacted) and packed.where("start = 0").count() == redacted.count()


@pytest.mark.parametrize("limit", [near_copies.LIMIT, 3])
def test_near_copies_of_five_words(spark, limit):
    """Texts with words changed: no two that stay share 0.8 of their shingles, and what goes is like one of smaller id."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = {}
    for _ in range(12):
        base = [word() for _ in range(r.choice((30, 100, 400)))]
        for _ in range(9):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25)):
                copy[r.randrange(len(base))] = word()
            texts[len(texts)] = " ".join(copy)
    texts |= {len(texts): "a b", len(texts) + 1: "a b", len(texts) + 2: None, len(texts) + 3: ""}
    grams = {i: {tuple((t or "").split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))} - {()} for i, t in texts.items()}
    near = {(a, b) for a in texts for b in texts if a < b and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()] + [(None, texts[0], "en", "s", 1)], DOCS)
    got = near_copies.one_of_each(docs, limit=limit)
    kept = {x.doc_id for x in got.collect()}
    assert got.columns == docs.columns and None in kept and not [p for p in near if kept >= set(p)]
    assert all(any((a, b) in near for a in texts if a < b) for b in set(texts) - kept) and len(kept) < len(texts)
    whole = pipeline.drop_near_copies(spark, docs, "")
    assert not [p for p in near if {x.doc_id for x in whole.collect()} >= set(p)]


def test_near_copies_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "other words under the same id here", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (3, "a b c d e f g", "en", "s", 1)]
    assert sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, DOCS)).collect()) == [1, 1, 2]


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        assert docs.count() == 0


def test_queries_registered():
    names = list(Q.QUERIES)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
