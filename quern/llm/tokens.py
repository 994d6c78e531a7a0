"""Exact ids of the word-level BPE, fast: each different word is encoded once and remembered.

The tokenizer normalises (NFC, lower case), drops white space and splits into pieces that never cross white
space. A text of Latin characters (below U+0250, where NFC changes nothing) is split by the same rule and
each piece is looked up. In other texts, words of such characters are looked up and the rest goes through
the tokenizer as it is, as do texts with control characters that Python and the tokenizer class differently.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Letters and numbers among the lower-cased characters below U+0250, and the vocabulary's split rule in those terms.
LETTER, NUMBER = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"
#: Capitals below U+0250 whose lower case is beyond it.
CAPITALS = "".join(chr(i) for i in range(0x250) if max(chr(i).lower()) >= "\u0250")
#: What the rule above doesn't cover: other characters, white space only to Python, and special tokens.
BEYOND = rf"[\x1c-\x1f{CAPITALS}\u0250-\U0010ffff]|<\|"
#: Bytes of words and ids that a memo holds at most, with what Python adds to each.
KEEP_BYTES = 32 << 20
OVERHEAD = 200


def byte_letters() -> dict[int, str]:
    """The usual printable stand-in of every byte: printable Latin-1 as is, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """encode(text) gives the ids as a uint32 array. Memory is bounded: a full memo starts anew."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = {b: ord(c) for b, c in byte_letters().items()}
        self.split = re.compile(PIECES).findall
        self.beyond = re.compile(BEYOND).search
        self.odd = re.compile(r"[\x1c-\x1f]").search
        self.words = _Memo(self.word)
        self.parts = _Memo(self.part)

    def part(self, piece: str) -> bytes:
        shown = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(text.lower())))

    def word(self, word: str) -> bytes:
        return self.all(word).tobytes() if self.beyond(word) else self.plain(word)

    def all(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> np.ndarray:
        if not self.beyond(text):
            raw = self.plain(text)
        elif self.odd(text):
            return self.all(text)
        else:
            raw = b"".join(map(self.words.__getitem__, text.split()))
        return np.frombuffer(raw, "<u4")


class _Memo(dict):
    """Starts anew when it holds too many bytes. A word that is long itself isn't kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.size = make, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        size = 4 * len(key) + len(value) + OVERHEAD
        if size > KEEP_BYTES >> 6:
            return value
        if self.size + size > KEEP_BYTES:
            self.clear()
            self.size = 0
        self[key] = value
        self.size += size
        return value


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
