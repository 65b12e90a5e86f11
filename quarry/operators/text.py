"""Text ranking: tokenisation, a tiled TF-IDF index, exact top-k per query.

Weights: tf(t, d) * idf(t), idf(t) = ln(1 + N / df(t)) over the document
corpus; score = cosine of query and document weight vectors; query terms
absent from the corpus carry no weight. Ties break on the smaller doc id.

The corpus is read once, at any number of queries (``index``): a task counts the
terms of ``TILE_DOCS`` documents at a time and writes a tile, the documents' ids and
packed (document, term, tf) postings, next to one row per distinct term of the
tile with its document count. Document frequencies, idf and norms follow from
these rows; ``weigh`` gives every tile its weights, unit-norm per document, and
keeps the terms that queries ask for.

Queries are cut into blocks, dense (query x term) matrices of unit norm. Tiles
and query blocks meet by slot (``topk``): a slot is a bounded share of the tiles, and
a group of query blocks is sent to every slot, so neither side passes through the
driver. A document block of ``BLOCK_DOCS`` carries its largest weight per term; a
block whose bound stays below the k-th best score of every query of a query block
is skipped. Only k rows per (slot, query) leave a task.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialise, scratch_dir
from quarry.sources.tables import spread

TOKEN_SPLIT = r"[^\p{L}]+"
TILE_DOCS = 2048
BLOCK_DOCS = 64
QUERY_BLOCK = 64
SLOT_BYTES = 32 << 20      # weights of the tiles that meet in one task, about
GROUP_BYTES = 16 << 20     # query blocks that a task holds at a time, about


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters of any script (empty strings are removed later)."""
    return F.split(F.lower(text), TOKEN_SPLIT)


def term_freq(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) -- explode + partial-aggregated count."""
    return (df.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
            .filter(F.col("term") != "")
            .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


# -- index ------------------------------------------------------------------------------

_INDEX = pa.schema([("tile", pa.int64()), ("docs", pa.int64()), ("postings", pa.binary()), ("code", pa.int32()),
                    ("term", pa.string()), ("df", pa.int64())])
_INDEX_DDL = "tile long, docs long, postings binary, code int, term string, df long"


def _tile(part: pa.RecordBatch, tile: int):
    """The postings row and the term rows of some documents (id, tokens)."""
    listed = part.column("tokens")
    offsets = listed.offsets.to_numpy()
    coded = listed.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
    known = np.array([w != "" for w in words.to_pylist()], bool)
    named = part.column("id").is_valid().to_numpy(zero_copy_only=False)
    use = known[codes] & named[doc] if len(codes) else np.zeros(0, bool)
    pair, tf = np.unique(doc[use] * max(len(words), 1) + codes[use], return_counts=True)
    doc, code = pair // max(len(words), 1), pair % max(len(words), 1)
    df = np.bincount(code, minlength=len(words))
    postings = pickle.dumps((part.column("id").to_pylist(), doc.astype(np.int32), code.astype(np.int32),
                             tf.astype(np.int32)), protocol=5)
    yield pa.RecordBatch.from_arrays(
        [pa.array([tile]), pa.array([part.num_rows]), pa.array([postings], pa.binary()), pa.nulls(1, pa.int32()),
         pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], schema=_INDEX)
    have = np.flatnonzero(df)
    n = len(have)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, tile)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(have.astype(np.int32)),
         words.take(pa.array(have)), pa.array(df[have])], schema=_INDEX)


def _index(batches):
    base, n = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, TILE_DOCS):
            yield from _tile(batch.slice(lo, TILE_DOCS), base + n)
            n += 1


def index(docs: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
    """The written index rows: tiles (tile, docs, postings) and their terms (tile, code, term, df)."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tfidf-index")
    text = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(tokens(F.col(doc_text)),
                                                                              F.array().cast("array<string>")).alias("tokens")))
    text.mapInArrow(_index, _INDEX_DDL).write.parquet(path)
    return spark.read.schema(_INDEX_DDL).parquet(path)


def idf_table(index: DataFrame) -> DataFrame:
    """(term, idf) written, one row per term of the corpus."""
    n_docs = index.agg(F.sum("docs")).first()[0] or 0
    return materialise(index.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
                       .select("term", F.log(F.lit(1.0) + F.lit(float(n_docs)) / F.col("df")).alias("idf")))


# -- weights ----------------------------------------------------------------------------

def _weigh(batches):
    for batch in batches:
        tiles, payloads = [], []
        for tile, postings, terms in zip(*(batch.column(c) for c in ("tile", "postings", "terms")), strict=True):
            ids, doc, code, tf = pickle.loads(postings.as_py())
            named = terms.values                       # struct array of code, idf, asked
            codes = named.field("code").to_numpy()
            idf = np.zeros(int(codes.max(initial=-1)) + 1)
            idf[codes] = named.field("idf").to_numpy()
            w = tf * idf[code]
            norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=len(ids)))
            asked = named.field("asked")
            wanted = asked.is_valid().to_numpy(zero_copy_only=False)
            place = np.full(len(idf), -1, np.int32)
            place[codes[wanted]] = np.arange(int(wanted.sum()))
            use = place[code] >= 0
            tiles.append(tile.as_py())
            payloads.append(pickle.dumps((ids, asked.filter(pa.array(wanted)).to_pylist(), doc[use], place[code[use]],
                                          w[use] / norm[doc[use]]), protocol=5))
        yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), pa.array(payloads, pa.binary())], ["tile", "payload"])


def weigh(index: DataFrame, idf: DataFrame, asked: DataFrame) -> DataFrame:
    """(tile, payload) written: unit-norm weights of the documents' terms that are in ``asked`` (term)."""
    known = idf.join(asked.select("term", F.col("term").alias("asked")), "term", "left").hint("shuffle_hash")
    terms = (index.filter("term is not null").select("tile", "code", "term").join(known, "term")
             .groupBy("tile").agg(F.collect_list(F.struct("code", "idf", "asked")).alias("terms")))   # terms of a tile
    tiles = index.filter("postings is not null").select("tile", "postings").join(terms, "tile")
    return materialise(tiles.mapInArrow(_weigh, "tile long, payload binary"))


# -- top k ------------------------------------------------------------------------------

def _query_block(ids: list, terms: list, weights: list):
    """(query ids, term -> row, unit-norm weights queries x terms) of a block's (query, term, weight)."""
    place, row = {}, {}
    at = [(place.setdefault(q, len(place)), row.setdefault(t, len(row))) for q, t in zip(ids, terms, strict=True)]
    m = np.zeros((len(place), len(row)))
    for (i, j), w in zip(at, weights, strict=True):
        m[i, j] = w
    return list(place), row, m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def block_scores(m: np.ndarray, dense: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the document blocks that some query's bound lets through."""
    n = dense.shape[1]
    pad = -n % BLOCK_DOCS
    blocks = np.pad(dense, ((0, 0), (0, pad))).reshape(len(dense), -1, BLOCK_DOCS)
    bound = m @ blocks.max(axis=2)
    docs = np.flatnonzero(np.repeat((bound + 1e-6 >= least[:, None]).any(axis=0), BLOCK_DOCS)[:n])
    return docs, np.round(m @ dense[:, docs], 6)


def _best(k: int):
    schema = pa.schema([("qid", pa.int64()), ("did", pa.int64()), ("score", pa.float64())])

    def run(tiles: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        blocks = [_query_block(*([e[c].as_py() for e in row] for c in ("id", "term", "w")))
                  for row in queries.column("rows")] if tiles.num_rows else []
        best = [[[] for _ in ids] for ids, _, _ in blocks]
        least = [np.zeros(len(ids)) for ids, _, _ in blocks]
        for payload in tiles.column("payload"):
            dids, terms, doc, code, w = pickle.loads(payload.as_py())
            for (_, row, m), mine, low in zip(blocks, best, least, strict=True):
                column = np.array([row.get(t, -1) for t in terms] or [-1], np.int64)[code]
                here = column >= 0
                if not here.any():
                    continue
                dense = np.zeros((m.shape[1], len(dids)))
                dense[column[here], doc[here]] = w[here]
                docs, scores = block_scores(m, dense, low)
                for i in range(len(mine)):
                    good = np.flatnonzero((scores[i] > 0) & (scores[i] >= low[i]))
                    if len(good) > 4 * k:
                        good = good[scores[i, good] >= np.partition(scores[i, good], -k)[-k]]
                    if len(good):
                        new = [(-s, dids[d]) for s, d in zip(scores[i, good].tolist(), docs[good].tolist(), strict=True)]
                        mine[i] = sorted(mine[i] + new)[:k]
                        if len(mine[i]) == k:
                            low[i] = -mine[i][-1][0]
        for (ids, _, _), mine in zip(blocks, best, strict=True):
            found += [(q, d, -s) for q, rows in zip(ids, mine, strict=True) for s, d in rows]
        q, d, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], schema=schema)

    return run


def topk(weights: DataFrame, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(qid, did, score, rank): the k best documents of each query; ``queries``: (id, term, w)."""
    spark = weights.sparkSession
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    cut = queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("id", "term", "w")).alias("rows"))                    # the queries of a block
    cut = materialise(cut)
    query_bytes = cut.agg(F.sum(F.size("rows"))).first()[0] or 0
    groups = max(1, -(-40 * query_bytes // GROUP_BYTES))
    tile_bytes = weights.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tile_bytes // SLOT_BYTES))
    group = F.pmod("block", F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    right = cut.select(group.alias("grp"), every.alias("slot"), "rows")
    left = weights.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
                          F.pmod(F.xxhash64("tile"), F.lit(slots)).cast("int").alias("slot"), "payload")
    found = (left.groupBy("grp", "slot").cogroup(right.groupBy("grp", "slot"))
             .applyInArrow(_best(k), "qid long, did long, score double"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def tfidf_topk(docs: DataFrame, doc_id: str, doc_text: str, queries: DataFrame, q_id: str, q_text: str,
               k: int) -> DataFrame:
    """(q_id, doc_id, score, rank) for the k best documents of every query that share a
    word with it. Documents and queries without an id take no part (documents count in N)."""
    rows = index(docs, doc_id, doc_text)
    idf = idf_table(rows)
    asked = queries.filter(F.col(q_id).isNotNull())
    tf = materialise(term_freq(asked.select(F.col(q_id).cast("long").alias(q_id), q_text), q_id, q_text))
    weights = weigh(rows, idf, tf.select("term").distinct())
    qw = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    best = topk(weights, qw, asked.count(), k)
    return best.select(F.col("qid").alias(q_id), F.col("did").alias(doc_id), "score", "rank")
