"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V

PUNCTUATION = ".,:;!?()[]{}'\"`"


def literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lookup(table: dict) -> Column:
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), literals(v) if isinstance(v, (tuple, list)) else F.lit(v)]
    return F.create_map(*pairs)


#: White space as Unicode has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def normalized(text: Column) -> Column:
    """Ends stripped, CRLF as LF, runs of spaces and tabs as one space, runs of newlines as one."""
    text = F.replace(stripped(text), F.lit("\r\n"), F.lit("\n"))
    # Only what changes is matched, not each single space.
    return F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}|\t", " "), "\n{2,}", "\n")


def is_valid_chunk(text: Column) -> Column:
    """At least 20 characters, of which at most 0.4 are neither letters, digits nor white space."""
    special = F.length(F.regexp_replace(text, r"(?U)[a-zA-Z0-9 \p{L}\p{N}\s]+", ""))
    return (F.length(text) >= 20) & (special / F.greatest(F.length(text), F.lit(1)) <= 0.4)


def content_hash(text: Column) -> Column:
    return F.md5(F.lower(text))


def page_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?im)^##\s+Page\s+(\d+)", 1), F.lit("")).cast("int")


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(F.replace(F.lower(t), F.lit("#"), F.lit("")))), lambda t: t != ""))


def hash_tags(text: Column) -> Column:
    return clean_tags(F.regexp_extract_all(text, F.lit(r"(?U)#(?<!\w#)([A-Za-z][A-Za-z0-9_-]*)"), 1))


def command_tags(text: Column) -> Column:
    """Tags of the commands in text; a pattern is only tried where one of its words is found."""
    words = lambda p: re.findall(r"(?:^|\|)(?:\\b)?([a-z-]+)", p)
    has = lambda lower, p: any_in(lower, words(p)) & F.rlike(lower, F.lit(p))
    none = F.array().cast("array<string>")
    return bound(F.lower(text), lambda lower: F.array_distinct(F.flatten(F.array(*[F.when(has(lower, p), literals(tags)).otherwise(none) for p, tags in V.COMMAND_TAGS]))))


def merged_tags(*groups: Column) -> Column:
    return clean_tags(F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups]))


def low_quality(text: Column) -> Column:
    """10: blank; 20: over 0.35 of it looks encoded; 8: fewer than five words; else 0."""
    text = F.coalesce(text, F.lit(""))
    coded = F.aggregate(F.regexp_extract_all(text, F.lit("([A-Za-z0-9+/=]{24,})"), 1), F.lit(0), lambda a, x: a + F.length(x))
    return (
        F.when(stripped(text) == "", 10)
        .when(coded / F.greatest(F.length(text), F.lit(1)) > 0.35, 20)
        .when(F.regexp_count(text, F.lit("[A-Za-z]{3,}")) < 5, 8)
        .otherwise(0)
    )


def flag_penalty(flags: Column, secret, coded, short) -> Column:
    has = lambda f: F.coalesce(F.array_contains(flags, f), F.lit(False))
    return F.when(has("secret_like"), F.lit(secret)).otherwise(0) + F.when(has("encoded_or_token_like"), F.lit(coded)).otherwise(0) + F.when(has("short_chunk"), F.lit(short)).otherwise(0)


def any_in(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def search_terms(query: Column, aliases: dict[str, tuple[str, ...]] | None = None, phrases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Words of a query for chunk search: at least 3 characters, no stop words, aliases expanded.

    ``aliases``: more words with what they stand for; ``phrases``: terms to add where a phrase is in the query.
    """
    stop, alias = literals(V.SEARCH_STOP), lookup({**V.QUERY_ALIASES, **(aliases or {})})
    words = F.transform(F.split(F.coalesce(query, F.lit("")), r"(?U)\s+"), lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION))))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    terms = F.filter(F.flatten(F.transform(words, lambda w: F.coalesce(alias[w], F.array(w)))), lambda w: ~F.array_contains(stop, w))
    for phrase, more in (phrases or {}).items():
        terms = F.when(F.contains(F.lower(F.coalesce(query, F.lit(""))), F.lit(phrase)), F.concat(terms, literals(more))).otherwise(terms)
    return F.array_distinct(terms)


def evidence_terms(text: Column, most: int = 30) -> Column:
    words = F.split(F.trim(F.replace(F.lower(text), F.lit("_"), F.lit(" "))), r"(?U)\s+")
    words = F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION + "-/")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(literals(V.SEARCH_STOP), w))), 1, most)


def gate_terms(query: Column) -> Column:
    words = F.transform(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)([\w-]+)"), 1), lambda w: F.btrim(w, F.lit("-_")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(literals(V.GATE_STOP), w)))


def variants(term: Column) -> Column:
    """A term, its base form and what is left without an ending; at least 3 characters each."""
    cut = [F.when(F.endswith(term, F.lit(e)) & (F.length(term) > len(e) + 3), F.left(term, F.length(term) - len(e))) for e in ENDINGS]
    return F.filter(F.array_distinct(F.array_compact(F.array(term, lookup(V.BASE_FORMS)[term], *cut))), lambda v: F.length(v) >= 3)


ENDINGS = V.ENDINGS


def overlap(terms: Column, text: Column) -> Column:
    """Share of terms of which a variant is in text (lower case). terms: array of arrays of variants."""
    hit = F.size(F.filter(terms, lambda vs: F.exists(vs, lambda v: F.contains(text, v))))
    return F.when(F.size(terms) > 0, hit / F.size(terms)).otherwise(0.0)


def is_current(query: Column) -> Column:
    return any_in(F.lower(F.coalesce(query, F.lit(""))), V.CURRENT_WORDS)


def is_temporal(query: Column) -> Column:
    lower, out = F.lower(F.coalesce(query, F.lit(""))), F.lit(False)
    for p in V.CURRENT_PATTERNS:
        out = out | F.rlike(lower, F.lit("(?iU)" + p))
    return out


def is_conceptual(query: Column, terms: Column) -> Column:
    lower = F.lower(F.coalesce(query, F.lit("")))
    return any_in(lower, V.CONCEPT_PHRASES) & F.arrays_overlap(terms, literals(("rag", "hybrid"))) & ~any_in(lower, V.CODE_WORDS)


def is_playbook(query: Column, terms: Column) -> Column:
    lower = F.lower(F.coalesce(query, F.lit("")))
    about = any_in(lower, ("ansible", "playbook")) | F.array_contains(terms, "playbook")
    return about & (F.arrays_overlap(terms, literals(("roles", "role"))) | any_in(lower, ("rolami", "rola")))


def is_legal(query: Column, terms: Column) -> Column:
    return F.arrays_overlap(terms, literals(V.LEGAL_WORDS)) | any_in(F.lower(F.coalesce(query, F.lit(""))), V.LEGAL_WORDS)


def graph_terms(text: Column, extra: Column | None = None, most: int = 8) -> Column:
    """Whole values, capitalised phrases of up to four words and longer tokens; unique without case, in order."""
    values = F.filter(F.transform(F.concat(F.array(text), extra) if extra is not None else F.array(text), lambda v: stripped(F.coalesce(v, F.lit("")))), lambda v: v != "")

    def of(v: Column) -> Column:
        phrases = F.regexp_extract_all(v, F.lit(r"\b([A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){0,3})\b"), 1)
        tokens = F.filter(F.regexp_extract_all(F.lower(v), F.lit(r"([A-Za-z0-9][A-Za-z0-9_-]{2,})"), 1), lambda t: (F.length(t) >= 4) & ~F.array_contains(literals(V.GRAPH_STOP), t))
        return F.concat(F.array(v), phrases, tokens)

    found = F.transform(F.flatten(F.transform(values, of)), lambda t: F.btrim(F.regexp_replace(t, r"(?U)\s+", " "), F.lit(" `\"'.,:;!?()[]{}")))
    return F.slice(unique_without_case(F.filter(found, lambda t: F.length(t) >= 3)), 1, most)


def unique_without_case(words: Column) -> Column:
    return F.aggregate(words, F.array().cast("array<string>"), lambda a, w: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(w)), a).otherwise(F.concat(a, F.array(w))))


def context_terms(text: Column, most: int = 10) -> Column:
    """Headings among the first 20 lines, and capitalised phrases."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("#")))
    heads = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    phrases = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){0,3})\b"), 1)
    return F.slice(unique_without_case(F.filter(F.concat(heads, phrases), lambda t: F.length(t) >= 3)), 1, most)


def qa_tags(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(any_in(text, words), F.lit(tag)) for tag, words in V.TECH_TAGS.items()]))


def canonical_url(url: Column) -> Column:
    """No fragment, scheme and host in lower case, one closing slash trimmed, an empty path as /."""
    plain = F.regexp_replace(url, "#.*$", "")
    head = F.lower(F.regexp_extract(plain, r"^([^:/?#]+://[^/?#]*)", 1))
    rest = F.substring(plain, F.length(head) + 1, F.length(plain))
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.+)$", 1)
    path = F.when(path == "", F.lit("/")).when(F.endswith(path, F.lit("/")) & (path != "/"), F.left(path, F.length(path) - 1)).otherwise(path)
    return F.concat(head, path, query)


def scope_prefix(url: Column) -> Column:
    """The part of a site that a crawl from url stays in."""
    path = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"^[^:/?#]+://[^/?#]*([^?]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parent = F.concat(F.regexp_replace(path, "/[^/]*$", ""), F.lit("/"))
    return (
        F.when(F.get(parts, 1) == "docs", F.concat(F.lit("/"), F.get(parts, 0), F.lit("/")))
        .when(F.endswith(path, F.lit("/")), path)
        .when(F.contains(F.element_at(F.split(path, "/"), -1), F.lit(".")), parent)
        .otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/")))
    )


def source_scope(source: Column) -> Column:
    """What a source's evidence may come from: host and first two parts of an address, the folder of a path, else the source itself."""
    name = F.trim(F.coalesce(source, F.lit("")))
    host = F.lower(F.regexp_extract(name, "^https?://([^/]+)", 1))
    parts = F.filter(F.split(F.regexp_extract(name, "^https?://[^/]+(/[^?#]*)", 1), "/"), lambda p: p != "")
    site = F.concat_ws("/", host, F.nullif(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("")))
    return F.when(F.rlike(name, F.lit("^https?://")), F.when(host == "", name).otherwise(site)).when(F.contains(name, F.lit("/")), F.regexp_replace(name, "/[^/]*$", "")).otherwise(name)


def is_crawlable(url: Column, host: Column, prefix: Column) -> Column:
    own = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.rlike(url, F.lit("^(?i)https?://")) & (own == F.lower(host)) & F.startswith(path, prefix) & ~F.rlike(path, F.lit(V.NO_PAGE))


def source_label(source: Column, page: Column) -> Column:
    source = F.coalesce(source, F.lit("unknown"))
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(source, F.lit(", page "), page.cast("string"))).otherwise(source)


def relation_name(relation: Column) -> Column:
    """The allowed relation type that a spelling stands for, else null."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(relation, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    name = F.coalesce(lookup(V.RELATION_ALIASES)[name], name)
    return F.when(name.isin(*V.RELATION_PRIORITY), name)


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once however often f looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entity_name(entity: Column) -> Column:
    """The canonical form of an entity's name; null for what is no entity."""
    name = F.btrim(F.regexp_replace(stripped(F.coalesce(entity, F.lit(""))), r"(?U)\s+", " "), F.lit("`\"'.,:;()[]{}"))
    plain = lambda n: F.trim(F.regexp_replace(F.translate(F.lower(n), "-_", "  "), r"(?U)\s+", " "))
    return bound(name, lambda n: bound(plain(n), lambda key: _entity(n, key)))


def _entity(name: Column, key: Column) -> Column:
    joined = F.replace(key, F.lit(" "), F.lit("_"))
    alias = lookup(V.ENTITY_ALIASES)
    noise = (
        key.isin(*V.ENTITY_NOISE)
        | joined.isin(*V.ENTITY_NOISE)
        | F.rlike(key, F.lit(r"^[0-9.]+$"))
        | (F.length(key) < 2)
        | (F.contains(name, F.lit("/")) & ~F.rlike(name, F.lit(r"\.(io|com|org|net|local|dom)\b")))
        | F.rlike(key, F.lit("^(oc|kubectl|systemctl|docker|podman) "))
        | F.rlike(joined, F.lit("_(user|pod|deployment|service|project)$"))
    )
    word = lambda w: F.when(w.isin(*V.ENTITY_LOWER), w).when(w.isin(*V.ENTITY_UPPER), F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1000))))
    titled = F.array_join(F.transform(F.split(key, " "), word), " ")
    short_upper = (F.length(name) <= 8) & (name == F.upper(name)) & (name != F.lower(name))
    return F.when(name == "", None).otherwise(F.coalesce(alias[key], alias[joined], F.when(noise, None).when(short_upper, name).otherwise(titled)))
