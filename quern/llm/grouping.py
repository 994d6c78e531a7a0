"""Union-find over written tables: links in, the smallest root that each node reaches out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

#: Links that a task joins before it hands on what is left of them.
AT_ONCE = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that isn't its own root: a union-find of the links (a, b), with path halving."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(names))], np.int64)
    own = roots != np.arange(len(names))
    return names[own], names[roots[own]]


def shortened(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same as ``links``, fewer: every task replaces its own by stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) >= AT_ONCE:
                a, b = forest(a, b)
            if len(a) >= AT_ONCE // 2:
                yield table()
                a, b = a[:0], b[:0]
        if len(a):
            a, b = forest(a, b)
            yield table()

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link: the smallest root reachable. nodes: (node, root); links: (a, b). Roots are different and none is null.

    Each task first joins its own links by union-find. Then each round takes the smallest label among a node's neighbours, and the label of
    that label, so rounds grow with the logarithm of a component's diameter. The second step joins only labels that have changed; they
    are broadcast if they are few, so the rows of one large component needn't meet by their label.
    """
    few = stored(shortened(links), "grouping-links")
    both = stored(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "grouping-both")
    linked = both.select(F.col("a").alias("node")).distinct()
    label = stored(nodes.join(linked, "node", "left_semi").select("node", "root", F.col("root").alias("label")), "grouping-labels")
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = label.join(seen, "node").select("node", "root", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        step = stored(step, "grouping-labels")
        moved = stored(step.where("label < root").select(F.col("root").alias("label"), F.col("label").alias("jumped")), "grouping-moved")
        new = stored(step.join(maybe_broadcast(moved), "label", "left").select("node", "root", "old", F.least("label", "jumped").alias("label")), "grouping-labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "root", "label")
