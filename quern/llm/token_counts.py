"""Offset-mapped token counts.

A whole document is encoded once. Byte-level tokens are lossless, so token lengths give every token's byte span, and the spans
are interval-joined to the document's sections by binary search. A token that crosses a boundary goes by an explicit
rule: to the section of its ``first`` byte, of its ``last`` byte, to the one with ``most`` of its bytes (the first of equals), or ``split``
by bytes, in fractions.

Sections are lines (each with the newline that ends it), or fields: columns that are joined by a separator, which
counts to the field before it.

Defined cases: null text or field: empty; an empty document: one empty section; null or repeated doc_id: kept, rows by document;
no rule by that name: ValueError; empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most", "split")
#: The split pattern that goes with the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, tuple] = {}


def loaded(path: str) -> tuple:
    """(encode, byte length of each id); one for each worker process and file."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _LOADED[path] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, size)
    return _LOADED[path]


def shares(token_end: np.ndarray, section_end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Both arrays are byte offsets where spans end; spans begin where the one before ends."""
    n = len(section_end)
    if not len(token_end):
        return np.zeros(n)
    start = np.r_[0, token_end[:-1]]
    first = np.searchsorted(section_end, start, "right")
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    last = np.searchsorted(section_end, token_end - 1, "right")
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float)
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(float)
    for i in np.flatnonzero(~inside):
        held = range(int(first[i]), int(last[i]) + 1)
        part = [min(int(token_end[i]), int(section_end[s])) - max(int(start[i]), int(section_end[s - 1]) if s else 0) for s in held]
        if rule == "most":
            out[held[int(np.argmax(part))]] += 1
        else:
            for s, p in zip(held, part):
                out[s] += p / (int(token_end[i]) - int(start[i]))
    return out


def section_ends(data: bytes, pieces: Sequence[bytes] | None) -> np.ndarray:
    if pieces is not None:
        return np.cumsum([len(p) for p in pieces])
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def attributed(docs: DataFrame, path: str, rule: str = "first", fields: Sequence[str] | None = None, separator: str = "\n") -> DataFrame:
    """(doc_id, section, n_chars, n_tokens, doc_tokens) of every section of every document.

    ``section``: the line's number from 0, or the field's place in ``fields``. n_tokens is a double under ``split``, else a long.
    """
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    whole = rule != "split"
    names = ["doc_id", "section", "n_chars", "n_tokens", "doc_tokens"]
    columns = list(fields) if fields else ["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = loaded(path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                values = [x or "" for x in row[1:]]
                if fields:
                    values = [v + separator if i < len(values) - 1 else v for i, v in enumerate(values)]
                text = "".join(values)
                data = text.encode("utf-8")
                ends = section_ends(data, [v.encode("utf-8") for v in values] if fields else None)
                ids = np.array(encode(text), np.int64)
                got = shares(np.cumsum(size[ids]), ends, rule)
                begins = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
                chars = np.diff(np.r_[0, np.cumsum(begins)][np.r_[0, ends]])
                for column, part in zip(out, ([row[0]] * len(ends), np.arange(len(ends)), chars, got, np.full(len(ends), len(ids)))):
                    column.append(part)
            if not out[0]:
                continue
            ids = pa.array([x for part in out[0] for x in part], pa.int64())
            rest = [np.concatenate(x) for x in out[1:]]
            rest[2] = rest[2].astype(np.int64) if whole else rest[2]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in rest)], names)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(columns)])
    return kept.mapInArrow(run, f"doc_id long, section long, n_chars long, n_tokens {'long' if whole else 'double'}, doc_tokens long")
