"""Document fingerprints by winnowing, in DataFrame functions only.

Every word gets a hash, every run of ``k`` words a hash of its word hashes, and of every ``w`` neighbouring
k-grams the one of smallest hash is kept, the rightmost on a tie, with its position. Texts that share a run of w + k - 1
words share a fingerprint entry (the match guarantee). Hash and position are packed into one long, hash first, position descending,
so that a plain minimum breaks ties rightmost; window minima come from log2(w) pairwise minima of shifted arrays.

The 36 bits that fit beside a position choose; a kept entry is then known by all 64 bits of its k-gram's hash.

Texts in lower case; words are [^\\x20\\x09-\\x0D]+. Fewer words than k: one k-gram of all of them. No words: no entries.

``with_next`` pairs each document with the next one in descending doc_id order. Ranges of ids are dealt out as buckets (an id that many rows
have, or none, is dealt by the hash of its texts), and each bucket gets a copy of the first row of the bucket below, so texts are
shuffled once. The buckets themselves are put in order in groups of ``GROUP``, and then the groups: no order is global but that of the groups.

Defined cases: null text: empty; null doc_id: after all others; equal doc_ids: ordered by a hash of the text, then the text, descending; a
single document: its own next; likeness of two texts without entries: 1; empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

K, W = 4, 16
POSITION_BITS = 27
HASH_BITS = 36
BUCKET_BYTES = 4 << 20
RANGES = 256
GROUP = 4096
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    none = F.array().cast("array<bigint>")
    return F.when(trimmed == "", none).otherwise(F.transform(F.split(trimmed, SPACE), lambda x: F.xxhash64(x)))


def grams(words: Column, k: int = K) -> Column:
    """Packed (hash, position) of each k-gram of an array column of word hashes."""
    n = F.size(words)

    def packed(h: Column, at: Column) -> Column:
        low = F.lit((1 << POSITION_BITS) - 1) - at.cast("long")
        return F.shiftleft(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)), POSITION_BITS).bitwiseOR(low)

    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: packed(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i))
    few = F.array(packed(F.xxhash64(words), F.lit(0)))
    return F.when(n >= k, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))


def winnowed(df: DataFrame, column: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """df with column ``out``: the entries (at, hash) kept of text column ``column``, by position. w is a power of two."""
    if w & (w - 1):
        raise ValueError("w is a power of two")
    words, low = f"__{out}_words", f"__{out}_low"
    df = df.withColumn(words, word_hashes(F.col(column)))
    df = df.withColumn(low, grams(F.col(words), k)).withColumn(f"__{out}_n", F.size(low))
    step = 1
    while step < w:
        df = df.withColumn(low, F.zip_with(low, F.slice(low, step + 1, F.greatest(F.size(low) - step, F.lit(0))), lambda a, b: F.least(a, b)))
        step *= 2
    full = F.slice(low, 1, F.greatest(F.col(f"__{out}_n") - (w - 1), F.lit(1)))
    last = (1 << POSITION_BITS) - 1
    at = lambda x: (F.lit(last) - x.bitwiseAND(F.lit(last))).cast("int")
    # A text of fewer words than k has one gram of all of them.
    gram = lambda i: F.when(F.size(words) >= k, F.xxhash64(*[F.get(words, i + j) for j in range(k)])).otherwise(F.xxhash64(words))
    df = df.withColumn(low, F.array_distinct(full))
    return df.withColumn(out, F.transform(low, lambda x: F.struct(at(x).alias("at"), gram(at(x)).alias("hash")))).drop(words, low, f"__{out}_n")


def hashes(entries: Column) -> Column:
    return F.transform(entries, lambda x: x.hash)


def shown(entries: Column) -> Column:
    """Entries as text: position:hash, by position."""
    return F.array_join(F.transform(entries, lambda x: F.concat(x["at"].cast("string"), F.lit(":"), F.lower(F.hex(x["hash"])))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two columns of hash arrays (already distinct)."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def bucketed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with key (doc_id, nulls lowest), mix (a hash of the text) and bucket: ranges of (key, mix), in order.

    Quantiles of the key give ranges, which are divided evenly; a key that is itself a range's worth of rows is divided by mix.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 62)))).withColumn("mix", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(1, -(-total // BUCKET_BYTES))
    coarse = min(wanted, RANGES)
    at = [i / coarse for i in range(1, coarse)]
    found = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.percentile_approx("key", at or [0.5], 20_000).alias("q")).first()
    if found.lo is None:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    cuts = [x for x in found.q if found.lo <= x <= found.hi] if at else []
    heavy = {x: cuts.count(x) for x in cuts if cuts.count(x) > 1}
    each = -(-wanted // coarse)
    # Ranges: (first key, end, buckets, divided by mix or by key).
    starts = sorted({found.lo, *cuts, *(x + 1 for x in heavy)} - {found.hi + 1})
    ranges = [(lo, hi, each * heavy.get(lo, 1), lo in heavy) for lo, hi in zip(starts, [*starts[1:], found.hi + 1])]
    base, bases = 0, []
    for _, _, n, _ in ranges:
        bases.append(base)
        base += n
    of = F.size(F.filter(F.array(*[F.lit(x[0]) for x in ranges]), lambda e: e <= F.col("key"))) - 1
    rows = rows.withColumn("__of", of)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__of"))
    lo, hi, parts = (pick([x[i] for x in ranges]) for i in range(3))
    by_key = (F.col("key") - lo).cast("double") / (hi - lo).cast("double")
    by_mix = F.col("mix").cast("double") / float(1 << 64) + 0.5
    inner = F.least(parts - 1, F.floor(F.when(pick([x[3] for x in ranges]), by_mix).otherwise(by_key) * parts))
    return rows.withColumn("bucket", (pick(bases) + inner).cast("long")).drop("__of")


def takers(tops: DataFrame) -> DataFrame:
    """tops (bucket, ...) with taker: the next higher bucket that has rows; the lowest for the highest one."""
    down = Window.partitionBy("group").orderBy(F.col("bucket").desc())
    rows = tops.withColumn("group", F.floor(F.col("bucket") / GROUP)).withColumn("taker", F.lag("bucket").over(down))
    # The highest bucket of a group is taken by the lowest of the group above: one row for each GROUP of buckets.
    groups = tops.groupBy(F.floor(F.col("bucket") / GROUP).alias("group")).agg(F.min("bucket").alias("low"))
    above = groups.select("group", F.coalesce(F.lag("low").over(Window.orderBy(F.col("group").desc())), F.min("low").over(Window.partitionBy())).alias("above"))
    return rows.join(F.broadcast(stored(above, "winnowing-groups")), "group").withColumn("taker", F.coalesce("taker", "above")).drop("group", "above")


def with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited (text), entries, edited_entries, next_entries of each document.

    ``edited``: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    """
    rows = bucketed(docs)
    tops = stored(rows.groupBy("bucket").agg(F.max(F.struct("key", "mix")).alias("top")).select("bucket", "top.key", "top.mix"), "winnowing-tops")
    takes = stored(takers(tops).select("key", "mix", "taker"), "winnowing-takes")
    heads = rows.join(maybe_broadcast(takes), ["key", "mix"]).groupBy("taker", "key", "mix").agg(F.max("text").alias("text"))
    copies = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", "mix", F.col("taker").alias("bucket"), F.lit(1).alias("copied"))
    order = Window.partitionBy("bucket").orderBy("copied", F.col("key").desc(), F.col("mix").desc(), F.col("text").desc())
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = rows.withColumn("copied", F.lit(0)).unionByName(copies).withColumn("follows", F.lead("text").over(order))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("follows", F.lit("")), F.lit(1), half))
    both = both.select("bucket", "copied", "key", "mix", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = winnowed(both, "text", "entries", k, w)
    both = winnowed(both, "edited", "edited_entries", k, w)
    return both.withColumn("next_entries", F.lead("entries").over(order)).where("copied = 0")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, k, w).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("entries")).alias("fingerprint"),
        shown(F.col("edited_entries")).alias("edited_fingerprint"),
        F.array_distinct(hashes(F.col("entries"))).alias("a"),
        F.array_distinct(hashes(F.col("edited_entries"))).alias("b"),
        F.array_distinct(hashes(F.col("next_entries"))).alias("c"),
    )
    return rows.withColumns({"near_edited": likeness("a", "b"), "near_next": likeness("a", "c")}).drop("a", "b", "c")
