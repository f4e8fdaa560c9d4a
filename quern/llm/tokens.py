"""Token ids of whole texts by a public byte-level BPE, word by word through a cache."""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from functools import lru_cache

import tiktoken

#: A space that always begins a token: white space on neither side.
_BORDER = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids, as bytes.

    ``ranks`` is the vocabulary as a rank file, ``pattern`` its split pattern; the ids are
    those that the same vocabulary gives in the tokenizers library.  The pattern never joins
    what stands on both sides of a space between two characters that are not white space, and
    that space always begins the next token.  So a text's ids are those of its first piece and
    of each later piece with its space, and pieces repeat: the first ``keep`` of them are kept
    (frequent ones come early), others are encoded anew; after as many of these as ``keep``
    says four times, the collection begins again.  A text is cut at the strings of ``added``
    tokens (string, id), the longest of those that begin first; all other strings are ordinary text.
    """

    def __init__(self, ranks: str, pattern: str, keep: int = 600_000, longest: int = 64, added: tuple[tuple[str, int], ...] = ()):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.keep, self.longest = keep, longest
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")
        self.added = {a.encode(): int(i).to_bytes(4, "little") for a, i in added if a}
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")")

    def encode(self, text: bytes) -> bytes:
        if not any(a in text for a in self.added):
            return self._ordinary(text)
        parts = self.cuts.split(text)
        return b"".join(self.added[p] if i % 2 else self._ordinary(p) for i, p in enumerate(parts))

    def _ordinary(self, text: bytes) -> bytes:
        pieces = text.split(b" ")
        try:
            head = self.first[pieces[0]]
            return head + b"".join(map(self.later.__getitem__, pieces[1:]))
        except _Unclean:
            runs = _BORDER.split(text.decode("utf-8", "replace"))
            return self.first.of(runs[0]) + b"".join(map(self.later.of, runs[1:]))


def added_tokens(vocabulary: str) -> tuple[tuple[str, int], ...]:
    """The added tokens (string, id) of a vocabulary in the tokenizers library's JSON."""
    with open(vocabulary, "rb") as f:
        found = json.load(f).get("added_tokens", [])
    for t in found:
        if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {t['content']!r} takes more than its own string")
    return tuple((t["content"], t["id"]) for t in found)


@lru_cache(maxsize=1)
def shared_encoder(ranks: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(ranks, pattern, added=added)


class _Unclean(Exception):
    """A piece with white space at an edge: the spaces beside it are not borders."""


class _Pieces(dict):
    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before, self.others = encoder, before, 0

    def __missing__(self, raw: bytes) -> bytes:
        piece = raw.decode("utf-8", "replace")
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unclean
        ids = self.of(piece)
        if len(raw) <= self.encoder.longest:
            if len(self) >= self.encoder.keep:
                self.others += 1
                if self.others > 4 * self.encoder.keep:
                    self.others = 0
                    self.clear()
            else:
                self[raw] = ids
        return ids

    def of(self, piece: str) -> bytes:
        ids = array("I", self.encoder.ordinary(self.before + piece))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()
