"""Toxicity by cumulative-link ordinal regression.

Severity grades 0..K-1 share one weight vector over sparse text features;
K-1 ordered thresholds separate them:

    P(grade >= k | x) = sigmoid(w . x - t_k),   t_1 < t_2 < ...

The expected severity is the sum of these probabilities; a document is
rejected if P(grade >= 1) is at least ``REJECT``.

Features: log(1 + count) of lower-cased words and of their first five
letters (compounds and inflections share a beginning).

Fitting: on the driver, from a bounded sample of labelled rows: at most
``MAX_TOXIC`` rows labelled toxic and ``MAX_CLEAN`` not, the smallest by a hash of the id.
Scoring covers every row and whole text, without a shuffle.

The labels are binary, so ``graded_sample`` orders the toxic ones itself:
grade 2 if the share of telling words (far more frequent among toxic
samples) is at least the median over toxic samples, else grade 1.

Defined results: null text is empty; an empty text scores by the thresholds
alone; null labels and labels without a document are not used, of several
labels of a document the highest counts; without both kinds of label
nothing is known, and every severity is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quarry.llm.common import bounded_batches, broadcast_if_small, end_task, shuffle_partitions
from quarry.session import materialise

MAX_TOXIC, MAX_CLEAN = 4096, 8192
REJECT = 0.4
MIN_DOCS = 4          # sample documents that must hold a feature
MIN_LOG_ODDS = 1.0    # features about as frequent on either side carry no weight
TELLING = 3.0         # log odds of a telling word
PREFIX = 5

_WORDS = re.compile(r"[^\W\d_]+").findall


def _hash(feature: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(feature.encode()) >> 1


def features(text: str) -> Counter:
    """Counts of words and of word beginnings (marked by a trailing *)."""
    words = Counter(_WORDS(text.lower()))
    for word, n in list(words.items()):
        if len(word) > PREFIX:
            words[word[:PREFIX] + "*"] += n
    return words


@dataclass
class Model:
    """Weights by feature hash and the thresholds t_1..t_{K-1}."""
    weights: dict[int, float]
    thresholds: np.ndarray
    _cache: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def _weight(self, feature: str) -> float:
        w = self._cache.get(feature)
        if w is None:
            if len(self._cache) >= 1 << 17:
                self._cache.clear()
            w = self._cache[feature] = self.weights.get(_hash(feature), 0.0)
        return w

    def linear(self, text: str) -> float:
        total = 0.0
        for feature, n in features(text).items():
            w = self._weight(feature)
            if w:
                total += w * np.log1p(n)
        return total

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, a column each."""
        z = np.clip(linear[:, None] - self.thresholds[None, :], -60, 60)
        return 1 / (1 + np.exp(-z))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_cols: int,
        l2: float = 2e-5, rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient steps (Adam) on the
    mean log loss over the K-1 cumulative links, from a sparse matrix in
    coordinate form."""
    k = int(grades.max())
    above = (grades[:, None] >= np.arange(1, k + 1)[None, :]).astype(float)
    # thresholds are t_1 and positive gaps, so their order cannot break
    w, raw = np.zeros(n_cols), np.concatenate([[2.0], np.zeros(k - 1)])
    m, v = np.zeros(n_cols + k), np.zeros(n_cols + k)
    for step in range(1, rounds + 1):
        gaps = np.exp(raw[1:])
        t = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, weights=values * w[cols], minlength=len(grades))[:, None] - t[None, :]
        err = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - above
        each = err.sum(axis=1) / len(grades)
        dw = np.bincount(cols, weights=values * each[rows], minlength=n_cols) + l2 * w
        dt = -err.mean(axis=0)
        draw = np.concatenate([[dt.sum()], [dt[j:].sum() * gaps[j - 1] for j in range(1, k)]])
        g = np.concatenate([dw, draw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w, raw = w - change[:n_cols], raw - change[n_cols:]
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def _feature_rows(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            found = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array([[_hash(x) for x in f] for f in found], pa.list_(pa.int64())),
                 pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["toxic", "features", "counts"])
    end_task()


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, toxic, features, counts) of the bounded labelled sample, written."""
    spark = docs.sparkSession
    known = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")))
    order = F.xxhash64("doc_id")
    chosen = (known.filter("toxic").orderBy(order, "doc_id").limit(MAX_TOXIC)
              .unionByName(known.filter("NOT toxic").orderBy(order, "doc_id").limit(MAX_CLEAN)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id", "text")).limit(MAX_TOXIC + MAX_CLEAN)     # ids may repeat
    bounded_batches(spark)
    found = rows.select("toxic", "text").repartition(shuffle_partitions(spark)).mapInArrow(
        _feature_rows, "toxic boolean, features array<long>, counts array<long>")
    return materialise(found.withColumn("row", F.monotonically_increasing_id()))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text). Only the features that
    carry weight reach the driver, for the rows of the bounded sample."""
    sample = labelled_sample(docs, labels)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    per_row = sample.select("row", "toxic", total.alias("total")).toPandas().sort_values("row")
    toxic = per_row["toxic"].to_numpy(bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Model({}, np.array([60.0]))
    odds = (F.log((F.col("in_toxic") + 0.5) / (n1 + 1))
            - F.log((F.col("in_all") - F.col("in_toxic") + 0.5) / (n0 + 1)))
    used = (sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
            .agg(F.count_if("toxic").alias("in_toxic"), F.count(F.lit(1)).alias("in_all"))
            .filter(F.col("in_all") >= MIN_DOCS).withColumn("odds", odds).filter(F.abs("odds") >= MIN_LOG_ODDS)
            .select("feature", ((F.col("odds") >= TELLING) & (F.col("in_toxic") >= MIN_DOCS)).alias("telling")))
    used = broadcast_if_small(materialise(used))
    entries = (sample.select("row", F.explode(F.arrays_zip("features", "counts")).alias("e"))
               .select("row", F.col("e.features").alias("feature"), F.col("e.counts").cast("int").alias("n"))
               .join(used, "feature").orderBy("row", "feature").toArrow())
    row = np.searchsorted(per_row["row"].to_numpy(), entries.column("row").to_numpy())
    names, col = np.unique(entries.column("feature").to_numpy(), return_inverse=True)
    count, telling = entries.column("n").to_numpy().astype(float), entries.column("telling").to_numpy()
    share = (np.bincount(row, weights=count * telling, minlength=len(toxic))
             / np.maximum(per_row["total"].to_numpy(float), 1))
    severe = share >= max(np.median(share[toxic]), 1e-9)
    grades = np.where(toxic, np.where(severe, 2, 1), 0)
    weights, thresholds = fit(row, col, np.log1p(count), grades, len(names))
    return Model(dict(zip(names.tolist(), weights.tolist(), strict=True)), thresholds)


def severity(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` plus severity (expected grade), p_toxic and grade
    (the largest k with P(grade >= k) at least one half), in place of columns of these names."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("severity", "p_toxic", "grade")])
    schema = df.schema

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                p = m.at_least(np.array([m.linear(t or "") for t in texts], dtype=float))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0]),
                     pa.array((p >= 0.5).sum(axis=1).astype(np.int32))],
                    [*part.schema.names, "severity", "p_toxic", "grade"])
        m._cache.clear()
        end_task()

    return df.mapInArrow(run, StructType([*schema.fields, StructField("severity", DoubleType()),
                                          StructField("p_toxic", DoubleType()), StructField("grade", IntegerType())]))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with the columns they had."""
    own = [f"__c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*own)
    scored = severity(renamed, model, own[df.columns.index(text_col)])
    return scored.filter(F.col("p_toxic") < REJECT).select(*own).toDF(*df.columns)
