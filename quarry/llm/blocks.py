"""Blocks of documents and their packed postings.

Joining per-document word frequencies to a corpus-wide word table row by row
would shuffle one row per (document, word). Here a task cuts its documents
into blocks; a block numbers its distinct words locally and sends each of
``parts`` word partitions one packed row: the words that hash there, and
for each the documents (numbered within the block) with their frequency.
The partition works out a value per distinct word and answers each block
with one sum per document, so that a block's rows meet again by block id.

Bounds: a block holds at most ``MAX_DOCS`` documents and about ``MAX_BYTES``
of text (one longer document is a block alone). A word that a large part of
a block's documents holds is *spread*: its partition also depends on the
block, so no partition receives the postings of a very common word from the
whole corpus.

A block id is (partition, number within it); like any Spark job without a
written input, the input must give the same rows per partition when a lost
task is run again (a file scan does).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

MAX_DOCS = 1 << 16
MAX_BYTES = 12 << 20
#: Share of a block's documents from which a word's postings are spread over partitions.
COMMON = 1 / 16

ROW = "part int, block long, docs boolean, payload binary"


class LocalIds(dict):
    """word -> its number in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def blocks(batches: Iterator[pa.RecordBatch], as_bytes: bool, most: int = MAX_BYTES) -> Iterator[tuple[int, list, list]]:
    """(block id, doc ids, texts); texts as bytes or str, about ``most`` bytes of them."""
    base = TaskContext.get().partitionId() << 33
    n, ids, texts, size = 0, [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            column = part.column("text")
            ids += part.column("doc_id").to_pylist()
            texts += (column.cast(pa.binary()) if as_bytes else column).to_pylist()
            size += column.nbytes
            if size >= most or len(ids) + 256 > MAX_DOCS:
                yield base + n, ids, texts
                n, ids, texts, size = n + 1, [], [], 0
    if ids:
        yield base + n, ids, texts


def word_parts(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)).astype(np.int64) % parts


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    lengths = np.fromiter(map(len, words), dtype=np.uint32, count=len(words))
    if len(lengths) and lengths.max() < 256:
        return b"".join(words), lengths.astype(np.uint8).tobytes()
    return b"".join(words), lengths.tobytes()


def unpack_words(joined: bytes, lengths: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.uint8 if len(lengths) == n else np.uint32).astype(np.int64))
    starts = np.concatenate([[0], ends[:-1]]) if n else ends
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _small(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def posting_rows(block: int, words: list[bytes], flat: np.ndarray, lens: np.ndarray, parts: int,
                 extra: np.ndarray | None = None, wanted: np.ndarray | None = None, spread: bool = True):
    """(part, payload) of a block. flat: local word number of each token, or -1;
    lens: tokens per document; extra: a count for each word, sent along;
    wanted: which words to send; spread: whether common words may be spread."""
    n_docs, n_words = len(lens), len(words)
    part = word_parts(words, parts)
    pairs = flat.astype(np.int64) * n_docs
    pairs += np.repeat(np.arange(n_docs, dtype=np.int32), lens)
    pairs = pairs[flat >= 0] if wanted is None else pairs[(flat >= 0) & wanted[flat]]
    pairs.sort()
    new = np.flatnonzero(np.diff(pairs, prepend=-1))
    freq = np.diff(new, append=len(pairs))
    pairs = pairs[new]
    word, doc = pairs // max(n_docs, 1), pairs % max(n_docs, 1)
    holders = np.bincount(word, minlength=n_words)
    if spread and n_docs >= 64:
        common = holders > COMMON * n_docs
        part[common] = (part[common] + block * 2654435761 % parts) % parts
    present = np.flatnonzero(holders > 0) if wanted is None else np.flatnonzero(wanted)
    order = present[np.argsort(part[present], kind="stable")]
    starts = np.concatenate([[0], np.cumsum(holders)])
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = order[a:b]
        at = np.concatenate([np.arange(starts[w], starts[w + 1]) for w in mine.tolist()]) if b - a < 64 else \
            np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(holders[mine])[:-1]]), holders[mine]) \
            + np.arange(holders[mine].sum())
        joined, lengths = pack_words([words[w] for w in mine.tolist()])
        payload = (len(mine), joined, lengths, _small(holders[mine]), doc[at].astype(np.uint16), _small(freq[at]),
                   None if extra is None else _small(extra[mine]), n_docs)
        yield int(part[mine[0]]), pickle.dumps(payload, protocol=5)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    part, block, docs, payload = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()),
                                       pa.array(docs, pa.bool_()), pa.array(payload, pa.binary())],
                                      ["part", "block", "docs", "payload"])


def row_batches(rows: Iterator[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch_of(held)
            held = []
    if held:
        yield batch_of(held)
