"""SuperMinHash near-duplicates against brute force: signatures, links, large groups, finer keys, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import grouping, superminhash

CLASH = ("n", "node", "key", "label", "sig", "digest", "component_id", "kept", "root", "copies")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})


def shingle_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} - {()}


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) * 100 >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return sorted(((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def changed(r, base, n):
    copy = list(base)
    for _ in range(n):
        copy[r.randrange(len(base))] = f"z{r.randrange(10**6)}"
    return " ".join(copy)


def family(seed, sizes, most):
    r, rows = random.Random(seed), []
    for words, copies in sizes:
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        rows += [changed(r, base, r.randrange(most(words) + 1)) for _ in range(copies)]
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_signature_estimates_similarity():
    """Shares of equal minima are the similarity, with a lower variance than independent minima would have on small sets."""
    r = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        pool = r.integers(0, 1 << 63, 60, np.int64).astype(np.uint64)
        a, b = np.sort(pool[:50]), np.sort(pool[10:])
        x, y = superminhash.signatures([a, b])
        errors.append((x == y).mean() - 40 / 60)
    independent = (40 / 60) * (20 / 60) / superminhash.HASHES
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.85 * independent


def test_signature_is_of_the_set_alone():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 63, n, np.int64).astype(np.uint64)) for n in (1, 2, 40, 3000, 40000, 7)]
    together = superminhash.signatures(sets)
    assert all((superminhash.signatures([s])[0] == g).all() for s, g in zip(sets, together))
    ranks = superminhash.signatures([sets[0]])[0] >> superminhash._FRACTION
    assert sorted(ranks.tolist()) == list(range(superminhash.HASHES))
    # Plain rank by rank, without stopping early.
    for s in sets[1:3]:
        least = np.full(superminhash.HASHES, 0xFFFFFFFF, np.uint32)
        for x in s:
            least = np.minimum(least, superminhash.signatures([np.array([x])])[0])
        assert (least == superminhash.signatures([s])[0]).all()


@pytest.mark.parametrize("limit", [superminhash.LIMIT, 3])
def test_against_brute_force(spark, limit):
    rows = family(3, [(30, 12), (120, 25), (400, 8)], lambda n: n // 14) + [(2 * i, f"v{i} only here") for i in range(50)]
    got = result(superminhash.near_duplicates(table(spark, rows), limit=limit))
    assert got == expected(rows) and 1 < len({c for _, _, c, _ in got}) < len(rows)


def test_just_below_the_similarity(spark):
    """A family whose texts are nearly similar enough, with some links: none lost, none made up."""
    rows = family(4, [(100, 80)], lambda n: 9)
    assert result(superminhash.near_duplicates(table(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 3000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "one"), (5, "ONE"), (None, "one"), (6, "one two"), (7, long), (8, long + " x"), (None, "no id"), (None, "no id"), (None, None)]
    rows += [(9, "twice the same"), (9, "twice the same"), (10, "twice the same"), (11, "É x y z"), (12, "é x y z"), (13, "a\x1cb c d"), (14, "a b c d")]
    got = result(superminhash.near_duplicates(table(spark, rows)))
    want = [(d, n, c, d == c) for d, n, c, _ in expected(rows) if d is not None] + [(d, n, c, d == c) for d, n, c, _ in expected(rows) if d is None]
    assert got == sorted(want, key=str)


def test_copies(spark):
    rows = [(i, "the very same text of a few words") for i in range(5000, 2000, -1)] + [(1, "the very same text of a few words more")]
    got = result(superminhash.near_duplicates(table(spark, rows)))
    assert {c for _, _, c, _ in got} == {1} if 100 * 7 >= 80 * 8 else {2001}
    assert sum(k for *_, k in got) == 1


def test_empty(spark):
    assert superminhash.near_duplicates(table(spark, [(1, "a")]).where("false")).count() == 0


def test_union_find(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(300), 100 + r.randrange(300)) for _ in range(120)] + [(1000, 1000 + i) for i in range(400)]
    nodes = sorted({x for p in pairs for x in p} | {5000})
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = grouping.components(spark.createDataFrame([(x, x) for x in nodes], "node long, root long"), links)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r.node: r.label for r in got.collect()} == {x: find(x) for x in linked}
