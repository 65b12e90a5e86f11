"""Exact k-nearest vectors (cosine) for a size-checked query side.

The query matrix is broadcast (after a size check; a larger query side is
scored in hash batches of whole queries, each within the bound); every Arrow batch of
the corpus is scored with numpy and a task's best k rows per query are
emitted, so the final ranking sees k x tasks candidates per query and no
(query, vector) pair is ever a row.

With more queries than ``PIVOTS`` most pairs are never computed: some queries
serve as pivots, a batch's vectors are grouped by their nearest pivot, and a
group whose angle to the pivot spans r cannot hold a vector nearer to a query
than the query's angle to the pivot less r (triangle inequality on the
sphere). A group is skipped for the queries whose k-th best angle so far is
smaller than that.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.batching import collect_in_batches

BROADCAST_QUERY_VALUES = 8_000_000     # max query-matrix entries broadcast to every task
PIVOTS = 16                            # queries that groups of vectors are measured by


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, mean vector c, vectors n): posexplode + avg per (group, position), reassembled in order."""
    per = (df.select(group, F.posexplode(vec).alias("pos", "x"))
           .groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")))
    return per.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"),
        F.max("n").alias("n"))


def knn(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, q_id: str, q_vec: str,
        k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, id, score, rank, ``carry`` columns of the vector): top-k by cosine, ties to the
    smaller id; scores rounded to 6. ``queries`` should be a written table: it is
    measured, then collected.

    The query vectors are broadcast in batches of whole queries, each within
    ``BROADCAST_QUERY_VALUES`` (one batch unless the query side is large)."""
    found = candidates(corpus, id_col, vec_col, queries, q_id, q_vec, k, carry).filter("vid is not null")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    carried = [F.col(f"c{n}").alias(c) for n, c in enumerate(carry)]
    return (found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
            .select(F.col("qid").alias(q_id), F.col("vid").alias(id_col), "score", "rank", *carried))


def candidates(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, q_id: str, q_vec: str,
               k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, vid, score, pairs, skipped, carried c0..): each task's best k per query, and a row without
    ids of how many (query, vector) pairs the task had and skipped."""
    cost = F.greatest(F.coalesce(F.size(q_vec), F.lit(0)), F.lit(0))
    pieces = collect_in_batches(queries.select(q_id, q_vec), q_id, cost, BROADCAST_QUERY_VALUES)
    if not pieces:
        pieces = [pd.DataFrame({q_id: pd.Series(dtype="int64"), q_vec: pd.Series(dtype=object)})]
    return reduce(DataFrame.unionByName, [_score_batch(corpus, id_col, vec_col, qp, q_id, q_vec, k, carry) for qp in pieces])


def skipped_share(found: DataFrame) -> float:
    """Share of the (query, vector) pairs that ``candidates`` never computed."""
    pairs, skipped = found.agg(F.sum("pairs"), F.sum("skipped")).first()
    return (skipped or 0) / pairs if pairs else 0.0


def _pivots(unit: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors, each the farthest from those before."""
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class _Best:
    """A task's best k (score, id, carried) of each query, and its k-th score."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(n)], np.full(n, -np.inf)

    def take(self, j: int, scores: np.ndarray, ids: np.ndarray, at: np.ndarray, carried: list) -> None:
        good = np.flatnonzero(scores >= self.least[j])
        if len(good) > 4 * self.k:
            good = good[scores[good] >= np.partition(scores[good], -self.k)[-self.k]]
        if len(good):
            new = [(-s, i, tuple(c[a].as_py() for c in carried))
                   for s, i, a in zip(scores[good].tolist(), ids[good].tolist(), at[good].tolist(), strict=True)]
            self.rows[j] = sorted(self.rows[j] + new, key=lambda r: r[:2])[:self.k]
            if len(self.rows[j]) == self.k:
                self.least[j] = -self.rows[j][-1][0]


def _score_batch(corpus: DataFrame, id_col: str, vec_col: str, qp: pd.DataFrame, q_id: str, q_vec: str,
                 k: int, carry: tuple[str, ...]) -> DataFrame:
    qids = qp[q_id].to_numpy(dtype=np.int64)
    qm = np.stack([np.asarray(v, dtype=np.float64) for v in qp[q_vec]]) if len(qp) else np.zeros((0, 0))
    qn = np.sqrt((qm * qm).sum(axis=1))
    pivots = _pivots(qm / qn[:, None], PIVOTS) if len(qp) > PIVOTS else None
    bc = corpus.sparkSession.sparkContext.broadcast((qids, qm, qn, pivots))
    kinds = [corpus.schema[c] for c in carry]

    def score(batches):
        import pyarrow as pa
        qids_, qm_, qn_, pivots_ = bc.value
        best, pairs, skipped, types = _Best(len(qids_), k), 0, 0, None
        to_pivot = None if pivots_ is None else _angle((qm_ / qn_[:, None]) @ pivots_.T)
        for b in batches:
            carried = [b.column(c) for c in carry]
            types = [c.type for c in carried]
            if b.num_rows == 0 or len(qids_) == 0:
                continue
            ids = b.column(id_col).to_numpy().astype(np.int64)
            vm = _matrix(b.column(vec_col))
            vn = np.sqrt((vm * vm).sum(axis=1))
            pairs += len(ids) * len(qids_)
            if pivots_ is None:
                groups = [(np.arange(len(ids)), np.arange(len(qids_)))]
            else:
                cosine = (vm @ pivots_.T) / vn[:, None]
                near = cosine.argmax(axis=1)
                groups = []
                for g in range(len(pivots_)):
                    rows = np.flatnonzero(near == g)
                    if len(rows):
                        nearest = to_pivot[:, g] - _angle(cosine[rows, g]).max()
                        # scores are rounded to 6 places, hence the allowance
                        asks = np.flatnonzero(np.cos(np.clip(nearest, 0, np.pi)) + 2e-6 >= best.least)
                        skipped += len(rows) * (len(qids_) - len(asks))
                        groups.append((rows, asks))
            for rows, asks in groups:
                if len(asks):
                    sims = np.round((vm[rows] @ qm_[asks].T) / np.outer(vn[rows], qn_[asks]), 6)
                    for n, j in enumerate(asks.tolist()):
                        best.take(j, sims[:, n], ids[rows], rows, carried)
        rows = [(int(q), i, -s, c) for q, mine in zip(qids_, best.rows, strict=True) for s, i, c in mine]
        none = [None] * len(rows)
        columns = [pa.array([*(r[0] for r in rows), None], pa.int64()), pa.array([*(r[1] for r in rows), None], pa.int64()),
                   pa.array([*(r[2] for r in rows), None], pa.float64()), pa.array([*none, pairs], pa.int64()),
                   pa.array([*none, skipped], pa.int64())]
        if types is not None:
            columns += [pa.array([*(r[3][n] for r in rows), None], t) for n, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "vid", "score", "pairs", "skipped",
                                                             *(f"c{n}" for n in range(len(carry)))])

    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("vid", T.LongType()),
                           T.StructField("score", T.DoubleType()), T.StructField("pairs", T.LongType()),
                           T.StructField("skipped", T.LongType()),
                           *(T.StructField(f"c{n}", f.dataType) for n, f in enumerate(kinds))])
    return corpus.select(id_col, vec_col, *carry).mapInArrow(score, schema)


def _matrix(col) -> np.ndarray:
    """(rows x dim) float64 from an Arrow list column: one reshape of the
    flat value buffer when every row has the same length (no per-row Python)."""
    offs = col.offsets.to_numpy()
    lens = np.diff(offs)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lens) and (lens == lens[0]).all():
        return flat.reshape(len(lens), int(lens[0]))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_pylist()])
