"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. All queues are laid along one time line, on which each source runs at its target share of the
tokens; when a source ends, its share goes to the others in proportion (``phases``). The line is cut into lanes of ``LANE`` tokens, and a
lane gets of each source the part of its queue that falls there, so what a source is owed at a lane's edge, less than a token, is carried from lane
to lane (``owed``). Within a lane, each window adds ``share x capacity`` to every source's deficit, and the source with the largest
deficit is served, at least ``grain`` tokens at a time, until the window is full; what was not served, or was served too early, carries
to the next window. Documents are cut where a window or a lane ends. A lane's last tokens go into windows whose lengths
are powers of two, so no window needs padding.

A document's place in its source's queue is (task that encoded it, place in that task): queue offsets come from per-task
sums, so neither a hot source nor a long document meets in one task.

Defined cases: null text: empty, so only the end token; null source: the queue ''; null or repeated doc_id: packed like
any other row; a share for a source without documents: ignored; a share that isn't positive: served when all others have ended; empty
table: empty result; extra columns: ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored
from .tokens import encoder

LANE = 1 << 20
WINDOW = 2048
GRAIN = 128
END = 1
#: A source gets at least this many tokens of a lane it takes part in; a rarer one takes part in fewer lanes.
LEAST = 64


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(chunk, source, place, doc_id, n, ids): ids as little-endian 16-bit, n with the end token, place: the source's tokens before it in this chunk."""
    schema = "chunk int, source string, place long, doc_id long, n long, ids binary"
    names = ["chunk", "source", "place", "doc_id", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, total = encoder(path).encode, TaskContext.get().partitionId(), defaultdict(int)
        if encoder(path).whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        for b in batches:
            ids, place, n = [], [], []
            sources = b.column(1).to_pylist()
            for source, text in zip(sources, b.column(2).to_pylist()):
                got = encode(text or "")
                ids.append(np.append(got, np.uint32(end)).astype("<u2").tobytes())
                n.append(len(got) + 1)
                place.append(total[source])
                total[source] += len(got) + 1
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(n), pa.int32()), b.column(1), pa.array(place, pa.int64()), b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text").mapInArrow(run, schema)


def serve(sizes: list[int], capacities: list[int], grain: int = GRAIN, shares: list[float] | None = None, owed: list[float] | None = None) -> Iterator[tuple[int, int, int]]:
    """(window, queue, tokens): whom each window is filled from, in order. sizes must add up to the capacities.

    ``shares``: target shares (the sizes by default), taken among the queues that aren't empty; ``owed``: deficits to begin with.
    """
    rest = np.array(sizes, np.int64)
    share = np.array(sizes if shares is None else shares, float)
    deficit = np.zeros(len(sizes)) if owed is None else np.array(owed, float)
    for w, capacity in enumerate(capacities):
        now = np.where(rest > 0, share, 0.0)
        now = now if now.sum() > 0 else rest.astype(float)
        deficit += now / max(now.sum(), 1.0e-300) * capacity
        space = capacity
        while space:
            q = int(np.argmax(np.where(rest > 0, deficit, -np.inf)))
            take = int(min(space, rest[q], max(grain, int(deficit[q]))))
            deficit[q] -= take
            rest[q] -= take
            space -= take
            yield w, q, take
            if not rest[q]:
                deficit[q] = 0.0


def phases(sizes: dict[str, int], shares: dict[str, float]) -> list[tuple[float, dict[str, float]]]:
    """(tokens, share of each queue) of the spans of the time line between which queues end. sizes: of each queue."""
    rest, out = {q: float(n) for q, n in sizes.items() if n > 0}, []
    while rest:
        live = {q: max(0.0, shares.get(q, 0.0)) for q in rest}
        live = live if sum(live.values()) > 0 else dict(rest)
        whole = sum(live.values())
        span = min(rest[q] * whole / live[q] for q in rest if live[q] > 0)
        out.append((span, {q: x / whole for q, x in live.items()}))
        ended = {q for q in rest if live[q] > 0 and rest[q] * whole / live[q] <= span * (1 + 1e-12)}
        rest = {q: n - span * live[q] / whole for q, n in rest.items() if q not in ended}
    return out


def capacities(total: int, window: int = WINDOW) -> list[int]:
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]


#: The name under which sources without a share of their own are one queue; no source has it.
OTHERS = "\x00others"


def queues(totals: DataFrame, shares: dict[str, float] | None, lane: int) -> tuple[DataFrame, list[float]]:
    """(source, size, rates, every) and the lengths of the phases: a source's tokens for each of the line's, by phase, and
    that it takes part in one lane of ``every``.

    Only the sums of the named sources and of all others come to the driver.
    """
    named = F.col("source").isin(*(shares or {})) if shares else F.lit(False)
    queue = F.when(named, F.col("source")).otherwise(F.lit(OTHERS))
    sums = {r.queue: int(r.n) for r in totals.groupBy(queue.alias("queue")).agg(F.sum("size").alias("n")).collect()}
    wanted = {q: float(x) for q, x in (shares or {}).items() if q in sums}
    if OTHERS in sums and wanted:
        wanted[OTHERS] = max(0.0, 1.0 - sum(max(0.0, x) for x in wanted.values()))
    line = phases(sums, wanted) or [(1.0, {})]
    rate = {q: [of.get(q, 0.0) / sums[q] for _, of in line] for q in sums}  # parts of the queue a token
    table = F.create_map(*[x for q, r in rate.items() for x in (F.lit(q), F.array(*map(F.lit, r)))]) if rate else F.lit(None).cast("map<string,array<double>>")
    rows = totals.select("source", "size", F.transform(table[queue], lambda r: r * F.col("size")).alias("rates"))
    fastest = F.array_max("rates") * float(lane)
    return rows.withColumn("every", F.greatest(F.lit(1), F.ceil(F.lit(float(LEAST)) / fastest)).cast("long")), [span for span, _ in line]


def place(at: Column, spans: list[float]) -> Column:
    """How far a queue (rates) has run at a time."""
    begin, out = 0.0, F.lit(0.0)
    for j, span in enumerate(spans):
        out = out + F.get("rates", F.lit(j)) * F.least(F.greatest(at - begin, F.lit(0.0)), F.lit(span))
        begin += span
    return out


def time(at: Column, spans: list[float]) -> Column:
    """When a queue (rates) gets to a place."""
    gone, out = F.lit(0.0), F.lit(0.0)
    for j, span in enumerate(spans):
        rate = F.get("rates", F.lit(j))
        into = F.when(rate > 0, F.least(F.greatest((at - gone) / rate, F.lit(0.0)), F.lit(span))).otherwise(F.when(at >= gone, F.lit(span)).otherwise(0.0))
        out, gone = out + into, gone + rate * span
    return out


def rate_at(at: Column, spans: list[float]) -> Column:
    begin, out = 0.0, F.get("rates", F.lit(0))
    for j, span in enumerate(spans):
        out, begin = F.when(at >= begin, F.get("rates", F.lit(j))).otherwise(out), begin + span
    return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, grain: int = GRAIN, end: int = END, shares: dict[str, float] | None = None, lane: int = LANE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``docs``: (doc_id, text, source). ``shares``: target shares by source; those without one share what is left of 1 by their sizes. By default
    every source has its part of all tokens, so that all run out together. A source that has run out leaves its share to the others.
    """
    got = stored(encoded(docs, path, end), "packing-ids")
    sums = stored(got.groupBy("source", "chunk").agg((F.sum("n")).alias("n")), "packing-sums")
    totals = sums.groupBy("source").agg(F.sum("n").alias("size"))
    whole = int(totals.agg(F.sum("size")).first()[0] or 0)
    lanes = max(1, -(-whole // lane))
    of, spans = queues(totals, shares, lane)
    order = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "chunk", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")).join(of, "source")
    base = stored(base, "packing-base")
    # A part g of the line is ``every`` lanes long; a source that has few tokens a lane has them all in one of these.
    part = F.col("every") * float(lane)
    edge = lambda g: F.when(g * F.col("every") >= lanes, F.col("size")).otherwise(F.floor(place(g * part, spans)))
    first, last = F.floor(time(F.col("a").cast("double"), spans) / part) - 1, F.floor(time((F.col("a") + F.col("n")).cast("double"), spans) / part) + 1
    one = F.least(F.lit(lanes - 1), F.col("g") * F.col("every") + F.pmod(F.xxhash64("source"), F.col("every")))
    cut = (
        got.join(maybe_broadcast(base), ["source", "chunk"])
        .withColumn("a", F.col("base") + F.col("place"))
        .select("*", F.explode(F.sequence(F.greatest(F.lit(0), first), F.least(last, F.lit(lanes)))).alias("g"))
        .withColumn("from", edge(F.col("g")))
        .withColumn("lo", F.greatest("a", "from"))
        .withColumn("hi", F.least(F.col("a") + F.col("n"), edge(F.col("g") + 1)))
        .where("lo < hi")
        .select(
            one.cast("long").alias("lane"),
            "source",
            "lo",
            "doc_id",
            (F.col("lo") - F.col("a")).alias("start"),
            F.col("n").alias("doc_tokens"),
            # The source's share where the lane begins, and what it is owed there.
            (rate_at(F.col("g") * part, spans) * F.col("every")).alias("share"),
            F.when(F.col("every") == 1, place(F.col("g") * part, spans) - F.col("from")).otherwise(0.0).alias("owed"),
            F.expr("substring(ids, cast(2 * (lo - a) + 1 as int), cast(2 * (hi - lo) as int))").alias("ids"),
        )
    )
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])

    def fill(keys, table):
        table = table.sort_by([("source", "ascending"), ("lo", "ascending")])
        source, docs, start, total = (table.column(c).to_pylist() for c in ("source", "doc_id", "start", "doc_tokens"))
        ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in table.column("ids").to_pylist()]
        names = sorted(set(source))
        queue = {s: [] for s in names}
        for i, s in enumerate(source):
            queue[s].append(i)
        sizes = [sum(len(ids[i]) for i in queue[s]) // 4 for s in names]
        share, owed = (table.column(c).to_pylist() for c in ("share", "owed"))
        share, owed = [share[queue[s][0]] for s in names], [owed[queue[s][0]] for s in names]
        at = [[0, 0] for _ in names]  # which of the queue's rows is next, and how much of it is gone
        offset, now, out = 0, -1, []
        for w, q, take in serve(sizes, capacities(sum(sizes), window), grain, share, owed):
            if w != now:
                now, offset = w, 0
            rows, here = queue[names[q]], at[q]
            while take:
                i, gone = rows[here[0]], here[1]
                n = min(take, len(ids[i]) // 4 - gone)
                part = memoryview(ids[i])[4 * gone : 4 * (gone + n)]
                out.append((docs[i], start[i] + gone, n, zlib.crc32(part), total[i], keys[0].as_py() << 24 | w, offset, names[q]))
                offset += n
                take -= n
                here[1] += n
                if 4 * here[1] == len(ids[i]):
                    here[0] += 1
                    here[1] = 0
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 8, schema)], schema=schema)

    return cut.groupBy("lane").applyInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
