"""Best-fit packing with bounds that certify the number of sequences.

A document's token ids are cut from the end into pieces of the limit; a first
piece that is shorter is what there is to pack. Full pieces are sequences of
their own. A task packs its documents' short pieces by best-fit decreasing
and compares the number of sequences with a lower bound from dual feasible
functions: three families, each maps lengths so that whatever fits one
sequence maps to at most 1 in all, so the mapped lengths add up to no more
than the sequences of any packing.

A group whose number equals its bound is certified and stays, but for a last
sequence at most half full. A group with a gap keeps the sequences that are
full without a small piece (an eighth of the limit at most: small pieces are
what gaps are filled with) and exchanges the documents of the others: these
are dealt by a hash of where they come from into new groups of about
``GROUP`` pieces, and best-fit decreasing runs again. After ``ROUNDS`` exchanges, or when one group
holds all that is left, what the last packing gives stays; ``certificates``
has each group's numbers, so what is left of the gaps is known.

Only (id, length, checksum) of short pieces are exchanged; a group holds a
bounded number of them, whatever the input. Rounds are written tables.

Ids come once per distinct unit from a task's bounded cache: a unit is a run
without white space and the one space before it, or a run of white space; the
tokenizer's pattern only cuts these further. Special strings inside a text are
handled as the library does by default.

Defined results: null text is empty (the end id alone); equal rows, and rows
with repeated or null ids, are packed one by one; no rows, no pieces.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_rows
from quarry.llm.packing import BYTE_CHARS
from quarry.llm.token_counts import specials, splitter, tokenizer
from quarry.session import materialise

MAX_LENGTH = 1024
#: Short pieces that are packed together, about (twice as many at most in a task of the first round).
GROUP = 1 << 15
#: Exchanges at most.
ROUNDS = 4
#: The pattern of byte-level pre-tokenisers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# -- packing ----------------------------------------------------------------------------

def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of each length: the longest first, each into the fullest bin that holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = [0] * len(lengths), [0] * len(lengths)
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    mask, n = 0, 0                                   # bit r: a bin with r free tokens
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, n = limit, n, n + 1
        bins[i], places[i] = b, limit - room
        left = room - size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return np.array(bins, np.int64), np.array(places, np.int64)


def lower_bound(lengths: np.ndarray, limit: int) -> int:
    """The largest bound of the dual feasible functions below on the number of bins.

    Rounding small and large lengths away, for each threshold e to half the
    limit: x > limit - e counts 1, x < e counts 0, others x / limit. Steps, for
    each k: x counts floor((k + 1) x / limit) / k unless (k + 1) x / limit is
    whole, then x / limit. Multiples of e: x below half counts floor(x / e) out
    of floor(limit / e), half counts a half, above half 1 less what limit - x counts."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=limit + 1).astype(np.int64)
    x = np.arange(limit + 1)
    count, total = np.cumsum(n), np.cumsum(n * x)
    e = np.arange(1, limit // 2 + 1)
    kept = total[limit - e] - total[e - 1]
    best = max(-(-int(total[-1]) // limit), int((-(-(limit * (count[-1] - count[limit - e]) + kept) // limit)).max(initial=0)))
    have = np.flatnonzero(n)
    x, n = have, n[have]
    k = np.arange(1, 101)[:, None]
    steps = np.where((k + 1) * x % limit == 0, k * x, limit * ((k + 1) * x // limit)) @ n
    best = max(best, int((-(-steps // (k[:, 0] * limit))).max()))
    e = e[:, None]
    whole = limit // e
    twice = np.where(2 * x < limit, 2 * (x // e), np.where(2 * x == limit, whole, 2 * (whole - (limit - x) // e))) @ n
    return max(best, int((-(-twice // (2 * whole[:, 0]))).max(initial=0)))


def pack_group(lengths: np.ndarray, limit: int, last: bool):
    """(bin, place, kept, bins, bound): which pieces stay where best-fit decreasing puts them."""
    bins, places = best_fit_decreasing(lengths, limit)
    n, bound = int(bins.max(initial=-1)) + 1, lower_bound(lengths, limit)
    fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
    least = np.full(n, limit)
    np.minimum.at(least, bins, lengths)
    stays = np.ones(n, bool) if last else 2 * fill > limit if n == bound else (fill == limit) & (8 * least > limit)
    return bins, places, stays[bins], n, bound


# -- rows -------------------------------------------------------------------------------

#: kind 0: a placed piece; 1: a piece to exchange; 2: a group's certificate
#: (doc_id: group, start: pieces, length: bins, ids_crc32: bound).
_SCHEMA = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()),
                     ("offset", pa.int64())])
_DDL = ("kind byte, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
        "offset long")


def _packed(docs: list, lengths: np.ndarray, crcs: np.ndarray, limit: int, last: bool, group: int, first_id: int):
    """The rows of one group; its sequences are numbered from ``first_id``."""
    bins, places, stays, n, bound = pack_group(lengths, limit, last)
    zero = np.zeros(len(docs) + 1, np.int64)
    more = lambda values, one, kind=np.int64: pa.array(np.append(values, one).astype(kind))
    yield pa.RecordBatch.from_arrays(
        [more(np.where(stays, 0, 1), 2, np.int8), pa.array([*docs, group], pa.int64()), pa.array(zero.astype(np.int32)),
         more(zero[1:], len(docs)), more(lengths, n), more(crcs, bound), more(first_id + bins, first_id),
         more(places, 0)], schema=_SCHEMA)


def rank_encoder(path: str, pattern: str):
    """The tokenizer file's merges as rank merges (tiktoken), some ten times faster for one
    unit; None unless the ids are in the order of the merges, since only then the
    two agree."""
    import json

    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    char_bytes = {chr(c): b for b, c in BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in BYTE_CHARS}
    ranks = {bytes(char_bytes[c] for c in token): i for token, i in model["vocab"].items()
             if all(c in char_bytes for c in token)}
    order = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = [i for token, i in ranks.items() if len(token) == 1]
    if order != sorted(order) or max(single) > order[0] or len(single) + len(order) < len(ranks) - 1:
        return None
    ranks = {token: i for token, i in ranks.items() if len(token) == 1 or i >= order[0]}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class UnitIds(dict):
    """unit -> its ids as little-endian unsigned 32-bit bytes; bounded.

    ASCII and Latin letters are in the same class for every library, whatever its
    version of Unicode; such units take the rank merges, the rest and the special
    strings the tokenizer's own library. Letters with or without the space before
    them are one match of the pattern; a mark after letters is a match of its own."""

    LATIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch

    def __init__(self, path: str, limit: int = 1 << 20, longest: int = 64):
        super().__init__()
        self.tokenizer, self.limit, self.longest = tokenizer(path), limit, longest
        self.special = set(specials(path))
        self.ranks = rank_encoder(path, PATTERN)

    def _ids(self, unit: str) -> list[int]:
        if self.ranks and unit not in self.special:
            if self.LATIN(unit):
                return self.ranks._encode_single_piece(unit)
            if unit.isascii():
                return self.ranks.encode_ordinary(unit)
        return self.tokenizer.encode(unit, add_special_tokens=False).ids

    def __missing__(self, unit: str) -> bytes:
        if unit[-1] in ".,;:!?" and self.LATIN(unit[:-1]):
            ids = self[unit[:-1]] + self[unit[-1]]
        else:
            found = self._ids(unit)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(unit) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = ids
        return ids


_CACHES: dict[str, UnitIds] = {}


def unit_ids(path: str) -> UnitIds:
    """The worker's cache for one tokenizer file."""
    if path not in _CACHES:
        _CACHES[path] = UnitIds(path)
    return _CACHES[path]


def _first_round(path: str, end_id: int, limit: int):
    end = struct.pack("<I", end_id)

    def cut(batches):
        """Per few documents: (doc, piece, start, length, crc) of the full and of the short pieces."""
        cache, split = unit_ids(path), splitter(specials(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                full, short = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = b"".join(map(cache.__getitem__, split(text))) + end
                    head = len(ids) // 4 % limit
                    if head:
                        short.append((doc, head, zlib.crc32(ids[:4 * head])))
                    for piece, start in enumerate(range(head, len(ids) // 4, limit), int(head > 0)):
                        full.append((doc, piece, start, zlib.crc32(ids[4 * start:4 * (start + limit)])))
                yield full, short

    def run(batches):
        part = TaskContext.get().partitionId()
        next_id, held = part << 36, []
        for full, short in cut(batches):
            held += short
            if full:
                docs, pieces, starts, crcs = zip(*full, strict=True)
                n, none = len(full), np.zeros(len(full), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(none.astype(np.int8)), pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()),
                     pa.array(starts, pa.int64()), pa.array(none + limit), pa.array(crcs, pa.int64()),
                     pa.array(np.arange(next_id, next_id + n)), pa.array(none)], schema=_SCHEMA)
                next_id += n
            if len(held) >= 2 * GROUP:
                yield from groups(held[:GROUP], part, next_id)
                next_id, held = next_id + GROUP, held[GROUP:]
        if held:
            yield from groups(held, part, next_id)

    def groups(rows, part, next_id):
        docs, lengths, crcs = zip(*rows, strict=True)
        return _packed(list(docs), np.array(lengths), np.array(crcs), limit, False, part, next_id)

    return run


def _again(limit: int, round_: int, last: bool):
    def run(key, table):
        group = key[0].as_py()
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        return pa.Table.from_batches(_packed(
            table.column("doc_id").to_pylist(), table.column("length").to_numpy(), table.column("ids_crc32").to_numpy(),
            limit, last, group, (round_ << 24 | group) << 36))

    return run


def packed(df: DataFrame, path: str, end_id: int = 2, limit: int = MAX_LENGTH, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The rows of all rounds, written: placed pieces and certificates (see ``_SCHEMA``), with ``round``."""
    text = text_rows(df, id_col, text_col)
    rows = materialise(text.mapInArrow(_first_round(path, end_id, limit), _DDL))
    done = rows.filter("kind != 1").withColumn("round", F.lit(0))
    for round_ in range(1, ROUNDS + 1):
        left = rows.filter("kind = 1")
        n = left.count()
        if not n:
            break
        groups = -(-n // GROUP)
        last = groups == 1 or round_ == ROUNDS
        dealt = left.withColumn("group", F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)))
        rows = materialise(dealt.groupBy("group").applyInArrow(_again(limit, round_, last), _DDL))
        done = done.unionByName(rows.filter("kind != 1").withColumn("round", F.lit(round_)))
    return done


def pieces(rows: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each placed piece."""
    return rows.filter("kind = 0").drop("kind", "round")


def certificates(rows: DataFrame) -> DataFrame:
    """round, group, pieces, bins, bound of each group that was packed; bins = bound: certified."""
    return rows.filter("kind = 2").select("round", F.col("doc_id").alias("group"), F.col("start").alias("pieces"),
                                          F.col("length").alias("bins"), F.col("ids_crc32").alias("bound"))


def pack(df: DataFrame, path: str, end_id: int = 2, limit: int = MAX_LENGTH, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece of each document, as ``pieces`` gives them."""
    return pieces(packed(df, path, end_id, limit, id_col, text_col))
