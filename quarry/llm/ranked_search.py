"""Ranked lexical search by dense blocked matrix products.

Documents are read once. A task keeps the terms that some item may hold (a
bit map of the item terms' hashes, of fixed size) and writes tiles of
``TILE_DOCS`` documents: their ids and lengths, and the postings of the kept
terms. The same pass counts, per task, the documents of each kept term, so
that the term weights of all items follow from written rows.

Items are cut into tiles of ``TILE_ITEMS``; a tile's distinct terms are its
compact vocabulary. A document tile is scored against an item tile as a
dense product in float64, weights (items x vocabulary) times impacts
(vocabulary x documents), in blocks of the vocabulary. Weights and impacts
are whole numbers, and a block is so narrow that no partial sum can reach
2^53: the product is exact in any order of addition. Blocks are added in
64-bit integers.

A task carries the best ``k`` documents of each item over its tiles: a
document is looked at if its score is not below the k-th so far, and equal
scores are cut by document id, so ties never depend on the tiling. The
candidates of all tasks are ranked per item, k rows a task at most.

Bounds: the bit map is 2^``BITS`` bits. Item tiles are sent to the tasks in
blocks of about ``BLOCK_BYTES``, each scored in a pass over the written tiles
(not the texts). Nothing of the documents but two totals reaches the driver.

A term is a maximal run of ASCII letters, digits and non-ASCII characters,
A-Z lower-cased. Integer scores: a term's weight is
floor(1000 ln((2N + 2) / (2 df + 1))), a document's length norm
m = 100 - B + (B n N) div L, and its score the sum over the item's distinct
terms of weight * ((10^9 tf) div (1000 tf + 8 m)).

Defined results: null text has no terms; an item or document without terms
gives no row; equal items, and items with repeated or null ids, are ranked
one by one; equal documents, and documents with repeated or null ids, take a
rank each (null ids last among equal scores).
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.blocks import LocalIds
from quarry.llm.common import UPPER, text_rows
from quarry.session import materialise

TILE_DOCS = 2048
TILE_ITEMS = 64
#: Terms of an item tile that one product takes at most.
TILE_TERMS = 2048
#: Postings of a document tile, about; it is cut when they are reached.
TILE_POSTINGS = 1 << 20
BITS = 24
BLOCK_BYTES = 16 << 20
#: Weight of the document's length, in hundredths.
B = 90
SCALE = 1_000_000_000
_EXACT = 1 << 53

TERM = "[0-9A-Za-z\\x80-\\xff]+"


# -- document tiles ---------------------------------------------------------------------

_TILE = pa.schema([("tile", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64()), ("term", pa.binary()),
                   ("payload", pa.large_binary())])
_TILE_DDL = "tile long, docs long, terms long, term binary, payload binary"


class Wanted(dict):
    """term -> whether some item may hold it; forgets everything at ``limit`` terms."""

    def __init__(self, bits: np.ndarray, limit: int = 1 << 19):
        super().__init__()
        self.bits, self.mask, self.limit = bits.tobytes(), 8 * bits.nbytes - 1, limit

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= self.limit:
            self.clear()
        h = zlib.crc32(term) & self.mask
        found = self[term] = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return found


def _least_type(values: list[int]) -> np.ndarray:
    top = max(values, default=0)
    return np.array(values, np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32
                    else np.uint64)


def _tiles(bits):
    lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
    terms_of = re.compile(TERM.encode()).findall

    def run(batches):
        wanted, base, number = Wanted(bits.value), TaskContext.get().partitionId() << 33, 0
        held: dict[bytes, int] = {}              # term -> documents of this task that hold it
        ids, sizes, each, terms, tfs, local = [], [], [], [], [], LocalIds()
        docs = words = 0

        def tile():
            payload = pickle.dumps((ids, np.array(sizes, np.int64), _least_type(each), list(local), _least_type(terms),
                                    _least_type(tfs)), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([docs]), pa.array([words]),
                                               pa.array([None], pa.binary()), pa.array([payload], pa.large_binary())],
                                              schema=_TILE)

        def holders():
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.array(held.values(), pa.int64()), pa.nulls(n, pa.int64()),
                 pa.array(list(held), pa.binary()), pa.nulls(n, pa.large_binary())], schema=_TILE)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    found = terms_of(text.translate(lower))
                    if not found:
                        continue
                    docs, words = docs + 1, words + len(found)
                    kept = [(t, n) for t, n in Counter(found).items() if wanted[t]]
                    if not kept:
                        continue
                    ids.append(doc)
                    sizes.append(len(found))
                    each.append(len(kept))
                    for t, n in kept:
                        terms.append(local[t])
                        tfs.append(n)
                        held[t] = held.get(t, 0) + 1
                    if len(ids) >= TILE_DOCS or len(tfs) >= TILE_POSTINGS:
                        yield tile()
                        number += 1
                        ids, sizes, each, terms, tfs, local = [], [], [], [], [], LocalIds()
                        docs = words = 0
            if len(held) >= 1 << 19:
                yield holders()
                held.clear()
        if docs:
            yield tile()
        if held:
            yield holders()

    return run


def document_tiles(df: DataFrame, bits: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written rows: tiles (tile, docs and terms seen, payload) and partial
    document counts of terms (term, docs)."""
    sent = df.sparkSession.sparkContext.broadcast(bits)
    return materialise(text_rows(df, id_col, text_col).mapInArrow(_tiles(sent), _TILE_DDL))


# -- items ------------------------------------------------------------------------------

def _item_terms(batches):
    lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
    terms_of = re.compile(TERM.encode()).findall
    for batch in batches:
        items, terms = [], []
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for item, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            mine = set(terms_of(text.translate(lower)))
            items += [item] * len(mine)
            terms += mine
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary())], ["item", "term"])


def term_bits(terms: DataFrame) -> np.ndarray:
    """The bit map of crc32(term) mod 2^BITS, gathered as at most 2^BITS / 32 words."""
    words = (terms.select(F.expr(f"(crc32(term) & {(1 << BITS) - 1}) div 32").alias("at"),
                          F.expr("shiftleft(1L, cast(crc32(term) & 31 as int))").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect())
    bits = np.zeros(1 << BITS >> 5, np.uint32)
    for r in words:
        bits[r["at"]] = r["bits"]
    return bits


# -- scores -----------------------------------------------------------------------------

def compact(rows: list[tuple[int, bytes, int]]) -> tuple[list[int], dict[bytes, int], np.ndarray]:
    """(items, term -> column, weights items x columns) of (item, term, weight) rows."""
    items, columns = LocalIds(), LocalIds()
    at = [(items[i], columns[t], w) for i, t, w in rows]
    weights = np.zeros((len(items), len(columns)))
    r, c, w = np.array(at).T
    weights[r, c] = w
    return list(items), dict(columns), weights


class Best:
    """The best k (score, document) of each item so far."""

    def __init__(self, items: list[int], k: int):
        self.items, self.k = items, k
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        self.least = np.ones(len(items), np.int64)       # a score below it cannot be among the best

    def take(self, scores: np.ndarray, docs: list) -> None:
        """scores: items x documents. Equal scores are ordered by document id."""
        at, doc = np.nonzero(scores >= self.least[:, None])
        cuts = np.flatnonzero(np.diff(at, prepend=-1, append=len(self.items)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i = int(at[a])
            mine, found = doc[a:b], scores[i, doc[a:b]]
            if b - a > 4 * self.k:                       # all that tie with the k-th stay for the cut by id
                enough = found >= np.partition(found, -self.k)[-self.k]
                mine, found = mine[enough], found[enough]
            new = [(-s, docs[d] is None, docs[d]) for s, d in zip(found.tolist(), mine.tolist(), strict=True)]
            self.rows[i] = sorted(self.rows[i] + new, key=lambda x: (x[0], x[1], x[2] or 0))[:self.k]
            if len(self.rows[i]) == self.k:
                self.least[i] = -self.rows[i][-1][0]


def scores(tile: tuple, vocabulary: dict[bytes, int], weights: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Whole-number scores, items x documents, of a document tile."""
    ids, _, each, terms, at, tfs = tile
    columns = np.fromiter((vocabulary.get(t, -1) for t in terms), np.int64, len(terms))[at]
    doc, tf = np.repeat(np.arange(len(ids)), each), tfs.astype(np.int64)
    impact = SCALE * tf // (1000 * tf + 8 * norms[doc])
    total = np.zeros((len(weights), len(ids)), np.int64)
    most = int(weights.max(initial=0)) * (SCALE // 1000)          # one term adds at most this
    width = max(1, min(TILE_TERMS, (_EXACT - 1) // max(most, 1)))
    for lo in range(0, weights.shape[1], width):
        here = (columns >= lo) & (columns < lo + width)
        if here.any():
            block = weights[:, lo:lo + width]
            dense = np.zeros((block.shape[1], len(ids)))
            dense[columns[here] - lo, doc[here]] = impact[here]
            total += np.matmul(block, dense).astype(np.int64)
    return total


def _score(items, n_docs: int, n_terms: int, k: int):
    def run(batches):
        tiles = [compact(rows) for rows in items.value]
        best = [Best(found, k) for found, _, _ in tiles]
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                tile = pickle.loads(payload)
                norms = 100 - B + B * tile[1] * n_docs // n_terms
                for (_, vocabulary, weights), mine in zip(tiles, best, strict=True):
                    mine.take(scores(tile, vocabulary, weights, norms), tile[0])
        for mine in best:
            rows = [(i, doc, -s) for i, found in zip(mine.items, mine.rows, strict=True) for s, _, doc in found]
            if rows:
                item, doc, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()),
                                                  pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank from 1, doc_id, score): each item's k highest-scoring documents
    with a score above 0, equal scores by document id."""
    spark = items.sparkSession
    asked = materialise(items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
                        .withColumn("item", F.monotonically_increasing_id()))
    terms = materialise(text_rows(asked, "item", "text").mapInArrow(_item_terms, "item long, term binary"))
    written = document_tiles(docs, term_bits(terms), id_col, text_col)
    tiles = written.filter("payload is not null").select("payload")
    n_docs, n_terms = written.filter("payload is not null").agg(F.sum("docs"), F.sum("terms")).first()
    holders = written.filter("term is not null").groupBy("term").agg(F.sum("docs").alias("df"))
    ratio = F.lit(2.0 * (n_docs or 0) + 2) / (2 * F.col("df") + 1).cast("double")
    weighed = terms.join(holders, "term").select("item", "term", F.floor(1000 * F.log(ratio)).alias("weight"))
    weighed = materialise(weighed.filter("weight > 0").withColumn("tile", F.expr(f"item div {TILE_ITEMS}")))
    size = weighed.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    found = []
    for block in range(blocks):
        rows = weighed.filter(F.pmod(F.xxhash64("tile"), F.lit(blocks)) == block).orderBy("tile", "item", "term").collect()
        by_tile: dict[int, list] = {}
        for r in rows:
            by_tile.setdefault(r.tile, []).append((r["item"], bytes(r.term), r.weight))
        sent = spark.sparkContext.broadcast(list(by_tile.values()))
        found.append(tiles.mapInArrow(_score(sent, n_docs, n_terms, k), "item long, doc_id long, score long"))
    if not found:
        found = [spark.createDataFrame([], "item long, doc_id long, score long")]
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = candidates.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
