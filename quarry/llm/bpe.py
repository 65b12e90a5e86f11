"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a byte string exactly one token can end its encoding.
``PrefixEncoder`` stores that token for each prefix: the candidates that end
at a position come from one pass of an Aho-Corasick automaton over the
vocabulary, and a candidate is right if it may follow the stored last token
of the prefix before it. A whole encoding is then read backwards. Since the
stored tokens never depend on later bytes, appending is exact and costs the
new bytes alone, and an edit re-encodes from the edit onwards only until the
stored tokens agree with the old ones again.

Two tokens may stand next to each other if merging their joined bytes by
rank gives the two tokens back; that test is memoised.

Defined results: null text is empty text and has no tokens; decoding returns
the exact bytes; special strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import WHITE, text_rows


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tokens, the automaton of their bytes, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 1 << 20):
        import ahocorasick
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.longest = max(self.lengths)
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.matcher.make_automaton()
        self._memo: dict[int, bool] = {}     # left << 32 + right
        self._limit = memo

    def merge(self, data: bytes) -> list[int]:
        """Rank merging of a short byte string, pair by pair."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; left -1 is the start of the text."""
        before = [] if left < 0 else [left]
        joined = b"".join(self.tokens[t] for t in before) + self.tokens[right]
        if len(self._memo) >= self._limit:
            self._memo.clear()
        known = self._memo[(left << 32) + right] = self.merge(joined) == [*before, right]
        return known

    def extend_steps(self, last: list[int], matches, offset: int = 0):
        """Appends the last token of each further prefix to ``last``, yielding after each."""
        memo, lengths, n = self._memo, self.lengths, len(last)
        for end, token in matches:
            end += offset
            if end < n:
                continue
            start = end + 1 - lengths[token]
            left = last[start - 1] if start else -1
            fits = memo.get((left << 32) + token)
            if fits or fits is None and self.neighbours(left, token):
                last.append(token)
                n += 1
                yield

    def extend(self, last: list[int], matches, offset: int = 0) -> None:
        for _ in self.extend_steps(last, matches, offset):
            pass

    def read_back(self, last: list[int]) -> list[int]:
        out, at, lengths = [], len(last), self.lengths
        while at:
            token = last[at - 1]
            out.append(token)
            at -= lengths[token]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """``extend`` from nothing and ``read_back``, in one loop without the steps."""
        known = self.ranks.get(data)
        if known is not None and self.merge_is_whole(known):
            return [known]
        last: list[int] = []
        memo, lengths, n = self._memo, self.lengths, 0
        for end, token in self.matcher.iter(data.decode("latin-1")):
            if end == n:
                start = n + 1 - lengths[token]
                left = last[start - 1] if start else -1
                fits = memo.get((left << 32) + token)
                if fits or fits is None and self.neighbours(left, token):
                    last.append(token)
                    n += 1
        return self.read_back(last)

    def merge_is_whole(self, token: int) -> bool:
        fits = self._memo.get(token - (1 << 32))
        return self.neighbours(-1, token) if fits is None else fits


class PrefixEncoder:
    """The last token of every prefix of a byte string that can grow and change."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []      # last[i]: the token that ends the prefix of i + 1 bytes
        self.append(data)

    def _matches(self, lo: int):
        """(end, token) of the vocabulary's matches in the bytes that can matter
        from ``lo`` on, longest first per end; ends count from the second value returned."""
        start = max(0, lo - self.vocabulary.longest + 1)
        return self.vocabulary.matcher.iter(self.data[start:].decode("latin-1")), start

    def append(self, data: bytes) -> None:
        self.data += data
        matches, start = self._matches(len(self.last))
        self.vocabulary.extend(self.last, matches, start)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts ``data`` in place of data[start:end]; returns how many prefixes
        were computed anew. Stops as soon as the stored tokens agree with the
        old ones over a whole longest token, since all later ones then must."""
        old, shift = self.last, start + len(data) - end
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        matches, offset = self._matches(start)
        agreed = 0
        for _ in self.vocabulary.extend_steps(self.last, matches, offset):
            was = len(self.last) - 1 - shift
            agreed = agreed + 1 if was >= end and old[was] == self.last[-1] else 0
            if agreed >= self.vocabulary.longest:
                break
        made = len(self.last) - start
        self.last.extend(old[len(self.last) - shift:])
        return made

    def ids(self) -> list[int]:
        return self.vocabulary.read_back(self.last)


class UnitIds(dict):
    """Encodings of white-space-bounded units as little-endian unsigned 32-bit bytes; bounded.

    A unit is a run of non-space characters with the one space before it, or
    a run of white space: the pattern's matches never cross a unit's border.
    """

    def __init__(self, path: str, pattern: str, limit: int = 1 << 19, longest: int = 64):
        super().__init__()
        import regex
        self.vocabulary = Vocabulary(read_ranks(path))
        # \s means White_Space in the reference library, also inside a negated class.
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]")
                                   .replace("(?!\\S)", f"(?![^{WHITE}])")).findall
        self.limit, self.longest = limit, longest

    def __missing__(self, unit: str) -> bytes:
        pieces = self.split(unit)
        if len(pieces) > 1:
            packed = b"".join(map(self.__getitem__, pieces))
        else:
            ids = self.vocabulary.encode(unit.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = packed
        return packed


#: Units of a text; the alternatives follow the tokenizers' own pattern, so a
#: unit's border is always a border between two of its matches.
UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

_CACHES: dict[tuple[str, str], UnitIds] = {}


def unit_ids(path: str, pattern: str) -> UnitIds:
    if (path, pattern) not in _CACHES:
        _CACHES[path, pattern] = UnitIds(path, pattern)
    return _CACHES[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit) of each whole text."""
    units = UNITS.findall

    def run(batches):
        cache = unit_ids(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [b"".join(map(cache.__getitem__, units(t))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.large_binary())],
                                                 ["doc_id", "ids"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (the exact bytes) to (doc_id, ids) rows."""
    vocab: dict[str, list[bytes]] = {}

    def run(batches):
        if path not in vocab:
            ranks = read_ranks(path)
            vocab[path] = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        token = vocab[path].__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                packed = part.column("ids").to_pylist()
                out = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in packed]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"),
                                                  pa.array(out, pa.large_binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
