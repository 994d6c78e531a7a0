"""Reversed lexical search against a plain scorer, in one block and in many, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=10):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc, c, size in own:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string").withColumns({c: F.lit("x") for c in ("score", "rank", "n", "terms", "counts", "item", "df")})


def texts(seed, n, words=40):
    r = random.Random(seed)
    return [" ".join(f"{r.choice('WwÉé')}{int(r.expovariate(0.05))}{r.choice(['', '.', '-x', '_y'])}" for _ in range(r.randrange(words))) for _ in range(n)]


DOCS = [(i, t) for i, t in enumerate(texts(1, 400))]
ODD = [(None, "w1 w2"), (None, None), (3, "w1 w2"), (3, "w1 w2"), (901, ""), (902, " \t.-"), (903, "日本\x00é\x7fx"), (904, "w1 " * 60000), (905, "Ω w1 w2 İ")]
ITEMS = [(i, t) for i, t in enumerate(texts(2, 60, 15))] + [(5, "w1 w2 W1"), (5, "w1 w2 W1"), (None, "w2"), (70, None), (71, ""), (72, "nowhere-at-all"), (73, "日本 é x ω")]


@pytest.mark.parametrize("size", [lexical.ITEM_BYTES, 300])
def test_against_plain_scores(spark, size):
    got = lexical.ranking(table(spark, DOCS + ODD, "doc_id"), table(spark, ITEMS, "item_id"), size=size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(DOCS + ODD, ITEMS)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in (9, 4, 7, 30, 12, 1, 2, 3, 5, 6, 8, 10)] + [(50 + i, "other text") for i in range(30)]
    got = lexical.ranking(table(spark, docs, "doc_id").repartition(7), table(spark, [(1, "words")], "item_id"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_sums_beyond_doubles(spark):
    """Where sums could pass 2^53, whole numbers are added instead, with the same result."""
    docs, items = table(spark, DOCS, "doc_id"), ITEMS[:20]
    index = lexical.Index([(i, t) for i, t in items if t is not None])
    rows = lexical.counted(docs, index)
    weights = np.full(len(index.number), 7, np.int64)
    score = lambda: sorted(map(tuple, lexical.scored(rows, index, weights, 400, 8000).collect()))
    plain = score()
    index.most = 1 << 40
    assert plain and score() == plain


def test_empty(spark):
    docs, items = table(spark, DOCS, "doc_id"), table(spark, ITEMS, "item_id")
    assert lexical.ranking(docs.where("false"), items).count() == 0 and lexical.ranking(docs, items.where("false")).count() == 0
