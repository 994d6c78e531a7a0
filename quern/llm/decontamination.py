"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document is contaminated by an item if it holds at least ``threshold`` of the item's different word shingles. Sizes differ
too much for a symmetric sketch, so items are partitioned by size, partition p having 2^p to 2^(p+1) - 1 shingles. Each partition has its
own sketch size: an item of m shingles can miss at most m - ceil(t m) of them, so one of any m - ceil(t m) + 1 is in every
contaminated document, and the partition takes the largest such number as its k. An item's k smallest shingle hashes (bottom-k
MinHash) are looked up among all shingles of a document, which loses nothing; documents with fewer shingles than an item of the
partition needs are passed over. Candidates are then verified on the shingles themselves, as text, in the whole document.

An item of fewer words than a shingle is looked up by windows of just its number of words (for each such number that items have).
DataFrame functions only. Words are runs of letters and digits in lower case, so case and punctuation don't hide a leak.

Defined cases: null or empty text: no shingles, never contaminated, nor an item; an item of fewer words than a shingle: its whole sequence is
its one shingle, found wherever these words follow each other; repeated items or documents: one row each; null ids: kept as null;
empty tables: empty result; extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

WORDS = 5
THRESHOLD = 0.8
#: Bytes of item texts up to which the items' shingles (some ten times as many) are broadcast.
ITEM_BYTES = 4 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """Hashes of the shingles of an array column of word hashes."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def shingles(words: Column, size: int = WORDS) -> Column:
    """Different shingles of a column of words; a column, as an expression would run again for each shingle."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    none = F.array().cast("array<string>")
    # Never null, so that no test for null is pushed below the projection that makes the words.
    return F.coalesce(F.array_distinct(F.when(n >= size, many).when(n > 0, F.array(F.array_join(words, " ")))), none)


# explode() would let the optimizer push a test of the array below the projection that makes its words, and so split the text
# again for every shingle; explode_outer() doesn't.
def hashed(df: DataFrame, size: int) -> DataFrame:
    """df with hashes, from its column text."""
    df = df.withColumn("__words", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)))
    return df.withColumn("hashes", shingle_hashes(F.col("__words"), size)).drop("__words")


def needed(m: Column, threshold: float) -> Column:
    return F.coalesce(F.ceil(F.round(m * F.lit(threshold), 6)).cast("int"), F.lit(0))


def sketched(items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(hash, item, need, part): the sketch of each item; need is how many shingles a document must share."""
    rows = hashed(items, size).withColumn("hashes", F.array_sort(F.array_distinct("hashes")))
    rows = rows.withColumn("m", F.coalesce(F.size("hashes"), F.lit(0))).where("m > 0").withColumn("part", F.floor(F.log2("m")).cast("int"))
    largest = F.expr("cast(shiftleft(2, part) - 1 as int)")
    k = F.least(F.col("m"), largest - needed(largest, threshold) + 1)
    rows = rows.select("item", "part", needed(F.col("m"), threshold).alias("need"), F.explode_outer(F.slice("hashes", F.lit(1), k)).alias("hash"))
    return rows.where("hash is not null")


def windows(words: Column, length: int) -> Column:
    """Hashes of the windows of ``length`` words of an array column of word hashes, by the rule for a whole sequence of so many."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.xxhash64(F.slice(words, i, length)))
    return F.when(n >= length, many).otherwise(F.array().cast("array<bigint>"))


def row_key() -> Column:
    """Tells rows apart that have no doc_id, or the same."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, item_id, n_shared, n_item, containment) of each contaminated document and its item.

    ``docs``: (doc_id, text); ``benchmark``: (item_id, text). ``row`` is row_key() of the document.
    """
    row = row_key().alias("row")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = stored(items.withColumn("item", F.xxhash64("item_id", "text")), "leaks-items")
    items = stored(items.withColumn("m", F.coalesce(F.size(words_of(F.col("text"))), F.lit(0))), "leaks-sized")
    sketch = stored(sketched(items, size, threshold), "leaks-sketch")
    short = sorted(r.m for r in items.where((F.col("m") > 0) & (F.col("m") < size)).select("m").distinct().collect())
    probes = docs.select(row, F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("__words"))
    probes = probes.withColumn("hashes", shingle_hashes(F.col("__words"), size)).withColumn("n", F.coalesce(F.size("hashes"), F.lit(0)))
    # A short item's only hash is that of a window of its length; documents of so few words have it as their shingle.
    for length in short:
        probes = probes.withColumn("hashes", F.concat("hashes", windows(F.col("__words"), length)))
    probes = probes.select("row", "n", F.explode_outer("hashes").alias("hash"))
    found = probes.join(maybe_broadcast(sketch), "hash").where("n >= need").select("row", "item").distinct()
    found = stored(found, "leaks-candidates")
    wanted = stored(found.groupBy("row").agg(F.collect_set("item").alias("items")), "leaks-wanted")
    # Broadcast or not goes by pairs of hashes, 16 bytes each, and for the items by the bytes of their texts.
    held = docs.withColumn("row", row).join(maybe_broadcast(wanted, found.count()), "row").distinct()
    held = held.withColumn("__words", words_of(F.col("text"))).withColumn("own", shingles(F.col("__words"), size))
    held = held.withColumn("said", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))) if short else held.withColumn("said", F.lit(""))
    whole = items.withColumn("__words", words_of(F.col("text"))).withColumn("shingles", shingles(F.col("__words"), size))
    whole = whole.select("item", "item_id", "shingles", needed(F.size("shingles"), threshold).alias("need"), (F.size("__words") < size).alias("short"))
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= ITEM_BYTES
    pairs = held.select("doc_id", "row", "own", "said", F.explode_outer("items").alias("item")).join(F.broadcast(whole) if small else whole, "item")
    inside = F.contains("said", F.concat(F.lit(" "), F.get("shingles", F.lit(0)), F.lit(" "))).cast("int")
    shared, n = F.when(F.col("short"), inside).otherwise(F.size(F.array_intersect("shingles", "own"))), F.size("shingles")
    rows = pairs.select("doc_id", "row", "item_id", shared.cast("long").alias("n_shared"), n.cast("long").alias("n_item"), "need").where("n_shared >= need")
    return rows.select("doc_id", "row", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the contaminated rows."""
    bad = stored(leaks(docs, benchmark, size, threshold).select(F.col("row").alias("__row")).distinct(), "leaks-rows")
    return docs.withColumn("__row", row_key()).join(maybe_broadcast(bad), "__row", "left_anti").select(*docs.columns)


#: The same by brute force: every document's shingles against every item's.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, text, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
  UNION SELECT doc_id, text, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM d, (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 4) WHERE len(w) >= n),
bs AS (SELECT DISTINCT item_id, text, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, text, count(*) AS n_item FROM bs GROUP BY item_id, text),
hits AS (SELECT ds.doc_id, ds.text AS dt, bs.item_id, bs.text AS bt, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ds.doc_id, ds.text, bs.item_id, bs.text)
SELECT doc_id, hits.item_id, n_shared, n_item, n_shared / n_item AS containment
FROM hits JOIN n ON n.item_id IS NOT DISTINCT FROM hits.item_id AND n.text = hits.bt
WHERE n_shared >= ceil(round(n_item * 0.8, 6))
"""
