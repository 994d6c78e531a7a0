"""A document's anchor (what it is about), its entities, and the relations that tie them; all within a row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as X

# The legal document that has an anchor and entities of its own, and what is no title.
LEGAL_ANCHOR = "Konstytucja Rzeczypospolitej Polskiej"
LEGAL_ENTITIES = (
    "Rzeczpospolita Polska", "Naród Polski", "Sejm", "Senat", "Prezydent Rzeczypospolitej", "Rada Ministrów", "Prezes Rady Ministrów",
    "Trybunał Konstytucyjny", "Trybunał Stanu", "Sąd Najwyższy", "Naczelny Sąd Administracyjny", "Krajowa Rada Sądownictwa",
    "Najwyższa Izba Kontroli", "Rzecznik Praw Obywatelskich", "Narodowy Bank Polski", "Krajowa Rada Radiofonii i Telewizji",
    "jednostki samorządu terytorialnego", "stany nadzwyczajne", "prawa i wolności", "wolności i prawa człowieka i obywatela",
)
NO_TITLE = ("imported document", "page", "copyright", "kancelaria sejmu", "dziennik ustaw", "unknown")
PHRASE = r"(?U)(?=\p{Lu})\b(\p{Lu}[\p{L}0-9-]+(?:\s+\p{Lu}[\p{L}0-9-]+){1,6})\b"


def is_legal(lower: Column, source: Column) -> Column:
    """lower: the text in lower case, never null."""
    return F.contains(lower, F.lit(LEGAL_ANCHOR.lower())) | (F.contains(lower, F.lit("konstytucja")) & F.contains(lower, F.lit("rzeczpospolitej polskiej"))) | F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit("d19970483"))


def title(value: Column) -> Column:
    """A cleaned title, or null for what is none."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(X.stripped(F.coalesce(value, F.lit(""))), r"^#+\s*", ""), r"(?U)\s+", " "), F.lit(" `\"'.,:;()[]{}"))
    return X.bound(clean, lambda c: F.when(~_no_title(c, F.lower(c)), c))


def _no_title(clean: Column, lower: Column) -> Column:
    return (
        F.rlike(lower, F.lit("#|https?://"))
        | lower.isin(*NO_TITLE)
        | F.rlike(lower, F.lit(r"^(page |strona |©)|^\d{4}[-./]\d{2}[-./]\d{2}$"))
        | ~F.length(clean).between(4, 140)
        | ~F.rlike(clean, F.lit(r"\p{L}"))
    )


def _upper(line: Column) -> Column:
    return (F.upper(line) == line) & (F.lower(line) != line)


def first_lines(text: Column, n: int) -> Column:
    """The first n lines; what comes after them is not split."""
    ends = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.slice(F.split(ends, "\n", n + 1), 1, n)


def with_lower(docs: DataFrame) -> DataFrame:
    """docs (text) with __lower, the text in lower case and never null; made once for all steps, as it is dear for texts that aren't ASCII."""
    return docs if "__lower" in docs.columns else docs.withColumn("__lower", F.lower(F.coalesce("text", F.lit(""))))


def with_anchor(docs: DataFrame) -> DataFrame:
    """docs (source, text) with anchor: from the first of 160 lines that looks like a title, else from the source's name."""
    rows = with_lower(docs).withColumn("__lines", first_lines(F.coalesce("text", F.lit("")), 160))

    def first(start: int, n: int) -> Column:
        found = F.transform(F.slice("__lines", start, n), lambda x: F.struct(x.alias("line"), title(x).alias("t")))
        fit = F.filter(found, lambda x: x.t.isNotNull() & ~F.startswith(F.lower(x.t), F.lit("art.")) & (F.startswith(F.ltrim(x.line), F.lit("#")) | _upper(x.t) | (F.size(F.split(x.t, " ")) >= 2)))
        return F.get(fit, F.lit(0)).t

    # Nearly always one of the first lines is a title; the others are only looked at where none is.
    rows = rows.withColumn("__t", F.coalesce(first(1, 4), first(5, 156)))
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.coalesce("source", F.lit("document")), "/"), -1), r"(?<=.)\.[^.]*$", ""), r"[_\s-]+", " "))
    named = F.when(~F.rlike(stem, F.lit(r"^[A-Z]?\d+[A-Za-z]{0,4}$")), title(stem))
    anchor = F.when(is_legal(F.col("__lower"), F.col("source")), F.lit(LEGAL_ANCHOR)).otherwise(F.coalesce(X.entity_name(F.col("__t")), "__t", named, "source", F.lit("document")))
    return rows.withColumn("anchor", anchor).drop("__t", "__lines", *[c for c in ["__lower"] if c not in docs.columns])


def with_entities(docs: DataFrame, most: int = 20) -> DataFrame:
    """docs (text, anchor) with entities: aliases, headings, lines in capitals and capitalised phrases, the most frequent and longest first."""
    # Columns of their own, as they are looked at once for each alias and line.
    made = [c for c in ["__lower"] if c not in docs.columns]
    docs = with_lower(docs).withColumn("__whole", F.coalesce(F.col("text"), F.lit("")))
    text, lower = F.col("__whole"), F.col("__lower")
    named = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(a.replace("_", " "))), F.lit(n)) for a, n in V.ENTITY_ALIASES.items()]))
    lines = F.transform(first_lines(text, 220), lambda x: X.stripped(x))
    heads = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("#"))), lambda x: F.regexp_replace(x, r"^#+\s*", ""))
    capitals = F.filter(lines, lambda x: F.length(x).between(4, 100) & ~F.startswith(x, F.lit("#")) & _upper(x))  # the dear test last
    found = F.concat(named, heads, capitals, F.regexp_extract_all(text, F.lit(PHRASE), 1))
    rows = docs.withColumn("__c", F.transform(found, lambda x: X.entity_name(title(x))))
    section = F.lit(r"^(art |art\.|rozdział|chapter|section)")
    fit = F.filter("__c", lambda x: x.isNotNull() & (x != F.col("anchor")) & ~F.lower(x).isin(*NO_TITLE) & ~F.rlike(F.lower(x), section) & (F.size(F.split(x, " ")) <= 8))
    rows = rows.withColumn("__c", X.unique_without_case(F.array_distinct(fit)))
    counted = F.transform("__c", lambda x: F.struct((-F.regexp_count(text, F.concat(F.lit(r"(?iu)\Q"), x, F.lit(r"\E")))).alias("n"), (-F.length(x)).alias("l"), x.alias("x")))
    best = F.slice(F.array_sort(F.filter(counted, lambda s: s.n < 0)), 1, most)
    return rows.withColumn("entities", F.transform(best, lambda s: s.x)).drop("__c", "__whole", *made)


def relations(docs: DataFrame, most: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, relation, target, document, and docs' columns ``keep``): the anchor is a document and contains its entities; the legal document has its own."""
    rows = with_entities(with_anchor(with_lower(docs)), most).withColumn("legal", is_legal(F.col("__lower"), F.col("source")))
    pair = lambda r, t: F.struct(F.lit(r).alias("relation"), t.alias("target"))
    own = F.filter(X.literals(LEGAL_ENTITIES), lambda e: F.contains("__lower", F.lower(e)))
    legal = F.concat(F.array(pair("is_a", F.lit("akt normatywny"))), F.transform(own, lambda e: pair("contains", e)))
    made = F.concat(F.array(pair("is_a", F.lit("dokument"))), F.transform("entities", lambda e: pair("contains", e)))
    made = F.when(F.col("legal"), F.concat(made, legal)).otherwise(made)
    rows = rows.select(*keep, F.col("anchor").alias("source"), F.explode_outer(made).alias("x"), F.col("source").alias("document"))
    return rows.select("source", "x.relation", "x.target", "document", *keep)
