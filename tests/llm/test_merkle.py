"""The Merkle manifest against a plain recursion, its log's positions, tampering, and odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(digests):
    """(root, proofs): plain recursion; a proof is a list of (left, right)."""
    proofs, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, p in zip(at, proofs):
            run = range(i // 16 * 16, min(i // 16 * 16 + 16, len(level)))
            p.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        level, at = [H(*level[j : j + 16]) for j in range(0, len(level), 16)], [i // 16 for i in at]
    return level[0], proofs


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        own[s] = tree([leaf(*r) for r in by[s]])
    root, over = tree([own[s][0] for s in order])
    out = []
    for s, up in zip(order, over):
        for r, p in zip(by[s], own[s][1]):
            digest = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                digest = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for x, y in p + up:
                digest = H(x, digest, y)
            out.append((r[0], leaf(*r), own[s][0], root, H(*[x + y for x, y in p + up]), digest, digest == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("leaf", "tree", "idx", "m", "digest", "root", "block", "__at")})


def made(n, sources, seed=0):
    r = random.Random(seed)
    rows = [(i * 3, f"Text {r.random()} É {'Ab ' * r.randrange(4)}", r.choice(["en", None]), r.choice(sources), r.choice([None, i])) for i in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [
    made(1, ["a"]), made(16, ["a"]), made(17, ["a"]), made(700, ["hot"] * 20 + [None, "", "é", "zz", "Z", "日本"]),
    [(1, None, None, None, None), (None, "No Id", "en", None, 5), (None, "No Id", "en", None, 5), (None, None, None, "a", None), (7, "A", "en", "a", 1), (7, "A", "en", "a", 1), (7, "B", "en", "a", 1), (15, "", "", "", 0), (5, "É ABC\n" * 20000, "en", "a", 1)],
], ids=["one", "run", "run and one", "hot and odd sources", "odd rows"])
def test_against_recursion(spark, rows):
    got = [tuple(r) for r in merkle.audit(table(spark, rows)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_many_sources_and_levels(spark):
    """Over 256 leaves of a source and over 256 sources: more than one round in both trees."""
    rows = made(4500, ["hot"] * 600 + [f"s{i}" for i in range(300)], 1)
    assert sorted((tuple(r) for r in merkle.audit(table(spark, rows)).collect()), key=str) == expected(rows)


def test_tampering_is_seen(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", "a", 1) for i in range(200)]
    got = {r.doc_id: r.verified for r in merkle.audit(table(spark, rows)).collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i in range(200) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}


def walked(n):
    """Nodes (level, index) in completion order, by hashing nothing."""
    out = []

    def visit(level, index):
        if level:
            for child in range(index * 16, min(index * 16 + 16, -(-n // 16 ** (level - 1)))):
                visit(level - 1, child)
        out.append((level, index))

    visit(merkle.height(n), 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 273, 4096, 4097, 5000])
def test_positions(n):
    assert [merkle.position(level, index, n) for level, index in walked(n)] == list(range(len(walked(n))))


def test_log_is_the_whole_tree(spark):
    rows = made(600, ["hot"] * 9 + ["b"], 2)
    own, over = merkle.manifest(table(spark, rows))
    got = {(r.tree, r.position): (r.level, r["index"], r.digest) for r in merkle.log(own).collect()}
    for s in ("hot", "b"):
        level = [leaf(*r) for r in sorted(r for r in rows if r[3] == s)]
        nodes, height = {}, 0
        while True:
            nodes |= {(height, i): d for i, d in enumerate(level)}
            if len(level) == 1:
                break
            level, height = [H(*level[j : j + 16]) for j in range(0, len(level), 16)], height + 1
        order = walked(sum(r[3] == s for r in rows))
        assert [got[s, k] for k in range(len(order))] == [(*node, nodes[node]) for node in order] and (s, len(order)) not in got


def test_empty(spark):
    assert merkle.audit(table(spark, made(3, ["a"])).where("false")).count() == 0
