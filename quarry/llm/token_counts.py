"""Token counts without token ids.

Texts are cut into pre-tokens; every distinct pre-token's pieces are counted
once, by the tokenizer's own library; the counts are joined to each
document's pre-token frequencies (packed postings, see ``blocks``) and
summed. No id is ever written.

A pre-token is a run of non-space characters with the one space before it,
or a run of white space. The library's own pattern only cuts these further,
so counts add up. Special strings are cut out first, as the library does by
default, and count as the library counts them.

Defined results: null text is empty: 0 bytes, 0 tokens; equal rows and
repeated or null ids each give a row of their own; no rows, no result rows.
"""

from __future__ import annotations

import os
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import blocks as B
from quarry.llm.bpe import UNITS
from quarry.llm.common import shuffle_partitions, text_rows

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def splitter(special: list[str]):
    """text -> its pre-tokens, special strings among them."""
    units = UNITS.findall
    if not special:
        return units
    apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return units(text)
        out = []
        for k, piece in enumerate(apart.split(text)):
            out += [piece] if k % 2 else units(piece)
        return out

    return split


def _send(path: str, parts: int):
    def rows(batches):
        split = splitter(specials(path))
        for block, ids, texts in B.blocks(batches, as_bytes=False):
            local = B.LocalIds()
            flat, lens, sizes = [], [], []
            for text in texts:
                units = split(text)
                flat.append(np.fromiter(map(local.__getitem__, units), dtype=np.int32, count=len(units)))
                lens.append(len(units))
                sizes.append(len(text.encode()))
            words = [w.encode() for w in local]
            joined = np.concatenate(flat) if flat else np.empty(0, np.int32)
            del local, flat
            yield block % parts, block, True, pickle.dumps((ids, np.array(sizes, np.int64)), protocol=5)
            for part, payload in B.posting_rows(block, words, joined, np.array(lens), parts):
                yield part, block, False, payload

    return lambda batches: B.row_batches(rows(batches))


def _count(path: str):
    def run(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        rows = []
        for block, docs, payload in zip(*(table.column(c).to_pylist() for c in ("block", "docs", "payload")),
                                        strict=True):
            if docs:
                rows.append((0, block, True, payload))
                continue
            n, joined, lengths, holders, doc, freq, _, n_docs = pickle.loads(payload)
            words = B.unpack_words(joined, lengths, n)
            new = [w for w in words if w not in known]
            for lo in range(0, len(new), 4096):
                some = new[lo:lo + 4096]
                for w, e in zip(some, tokenizer(path).encode_batch_fast([w.decode() for w in some],
                                                                        add_special_tokens=False), strict=True):
                    known[w] = len(e)
            each = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
            total = np.bincount(doc, weights=np.repeat(each, holders) * freq.astype(np.int64), minlength=n_docs)
            rows.append((0, block, False, total.astype(np.uint32 if total.max() < 1 << 32 else np.uint64).tobytes()))
        return pa.Table.from_batches([B.batch_of(rows)])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    docs, sums = None, 0
    for is_docs, payload in zip(table.column("docs").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if is_docs:
            docs = pickle.loads(payload)
    ids, sizes = docs
    for is_docs, payload in zip(table.column("docs").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if not is_docs:
            sums = sums + np.frombuffer(payload, np.uint32 if len(payload) == 4 * len(ids) else np.uint64).astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()),
                     "n_tokens": pa.array(np.zeros(len(ids), np.int64) + sums, pa.int64())})


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each whole text for a ``tokenizers`` file."""
    parts = 4 * shuffle_partitions(df.sparkSession)
    sent = text_rows(df, id_col, text_col).mapInArrow(_send(path, parts), B.ROW)
    counted = sent.groupBy("part").applyInArrow(_count(path), B.ROW)
    return counted.groupBy("block").applyInArrow(_add_up, "doc_id long, n_bytes long, n_tokens long")
