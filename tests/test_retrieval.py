"""Ranking operators: TF-IDF and kNN match brute force however they are cut; bounded expansion."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, text, vectors


def brute_tfidf(docs, queries, k):
    """(query, document, score, rank) by the definition, in plain Python."""
    words = lambda s: collections.Counter(w for w in re.split(r"[\W\d_]+", (s or "").lower()) if w)
    tf = {i: words(s) for i, s in docs}
    df = collections.Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(1 + len(docs) / n) for w, n in df.items()}
    weigh = lambda c: {w: n * idf[w] for w, n in c.items() if w in idf}
    norm = lambda c: math.sqrt(sum(x * x for x in c.values()))
    vecs = {i: weigh(c) for i, c in tf.items()}
    out = []
    for q, s in queries:
        mine = weigh(words(s))
        scored = [(-round(sum(x * v.get(w, 0) for w, x in mine.items()) / norm(mine) / norm(v), 6), i)
                  for i, v in vecs.items() if set(v) & set(mine)]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("limits", [{}, {"GROUP_BYTES": 400, "QUERY_BLOCK": 2, "SLOT_BYTES": 2000}])
def test_tfidf_equals_brute_force(spark, monkeypatch, limits):
    """One group of query blocks, and many small groups and slots; documents without words, NULLs and ties."""
    for name, value in limits.items():
        monkeypatch.setattr(text, name, value)
    rng = np.random.default_rng(3)
    names = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    docs = [(i, " ".join(rng.choice(names, int(rng.integers(1, 30))))) for i in range(700)]
    docs += [(700, None), (701, ""), (702, "12 34"), (703, docs[0][1]), (704, docs[0][1].upper())]
    queries = [(q, " ".join(rng.choice(names, 4))) for q in range(9)] + [(9, "unknown"), (10, None), (11, "Waa waa; WAB")]
    got = text.tfidf_topk(spark.createDataFrame(docs, "d long, t string").repartition(3), "d", "t",
                          spark.createDataFrame(queries, "q long, t string"), "q", "t", 5)
    assert sorted(map(tuple, got.collect())) == sorted(brute_tfidf(docs, queries, 5))


def test_blocks_below_the_best_are_skipped():
    rng = np.random.default_rng(0)
    m = rng.random((3, 10))
    dense = rng.random((10, 200)) * (np.arange(200) < 70)
    full = np.round(m @ dense, 6)
    least = np.sort(full, axis=1)[:, -5]
    docs, scores = text.block_scores(m, dense, least)
    assert len(docs) == 128 and (scores == full[:, docs]).all()
    docs, _ = text.block_scores(m, dense, np.zeros(3))
    assert len(docs) == 200


def test_a_query_without_a_match_gets_the_first_documents(spark):
    from quarry.plans.retrieval import with_fallback
    docs = spark.createDataFrame([(i,) for i in (9, 4, 7, 2, None)], "doc_id long")
    asked = spark.createDataFrame([(1,), (2,), (None,)], "item_id long")
    top = spark.createDataFrame([(1, 9, 0.5, 1), (1, 4, 0.0, 2)], "item_id long, doc_id long, score double, rank long")
    got = sorted(map(tuple, with_fallback(top, asked, docs, 3).collect()), key=str)
    assert got == sorted([(1, 9, 1), (2, 2, 1), (2, 4, 2), (2, 7, 3), (None, 2, 1), (None, 4, 2), (None, 7, 3)], key=str)


@pytest.mark.parametrize("budget", [10 ** 6, 16])
def test_knn_batches_brute_force(spark, monkeypatch, budget):
    """One broadcast, and query batches of at most two 8-d queries, both exact."""
    monkeypatch.setattr(vectors, "BROADCAST_QUERY_VALUES", budget)
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(200, 8))
    corpus = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(200)], "id long, v array<double>")
    qv = rng.normal(size=(6, 8))
    q = spark.createDataFrame([(j, qv[j].tolist()) for j in range(6)], "qid long, c array<double>")
    got = vectors.knn(corpus.repartition(3), "id", "v", q, "qid", "c", 5).collect()
    sims = np.round((vecs @ qv.T) / np.outer(np.linalg.norm(vecs, axis=1), np.linalg.norm(qv, axis=1)), 6)
    for j in range(6):
        want = list(np.lexsort((np.arange(200), -sims[:, j]))[:5])
        mine = [r["id"] for r in sorted((r for r in got if r["qid"] == j), key=lambda r: r["rank"])]
        assert mine == want


def test_knn_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(300, 8))
    corpus = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(300)], "id long, v array<double>")
    qv = rng.normal(size=(4, 8))
    q = spark.createDataFrame([(j, qv[j].tolist()) for j in range(4)], "qid long, c array<double>")
    got = vectors.knn(corpus.repartition(5), "id", "v", q, "qid", "c", 7).collect()
    sims = np.round((vecs @ qv.T) / np.outer(np.linalg.norm(vecs, axis=1), np.linalg.norm(qv, axis=1)), 6)
    for j in range(4):
        want = list(np.lexsort((np.arange(300), -sims[:, j]))[:7])
        mine = [r["id"] for r in sorted((r for r in got if r["qid"] == j), key=lambda r: r["rank"])]
        assert mine == want


def test_knn_skips_far_groups(spark):
    """More queries than pivots over clustered vectors: exact, with most pairs never computed."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    vecs = np.repeat(centres, 250, axis=0) + 0.05 * rng.normal(size=(2000, 16))
    qv = np.repeat(centres, 5, axis=0) + 0.05 * rng.normal(size=(40, 16))
    corpus = spark.createDataFrame([(i, vecs[i].tolist(), f"n{i}") for i in rng.permutation(2000).tolist()],
                                   "id long, v array<double>, note string").repartition(2)
    q = spark.createDataFrame([(j, qv[j].tolist()) for j in range(40)], "qid long, c array<double>")
    got = vectors.knn(corpus, "id", "v", q, "qid", "c", 5, ("note",)).collect()
    sims = np.round((vecs @ qv.T) / np.outer(np.linalg.norm(vecs, axis=1), np.linalg.norm(qv, axis=1)), 6)
    want = {(j, int(i), n + 1) for j in range(40) for n, i in enumerate(np.lexsort((np.arange(2000), -sims[:, j]))[:5])}
    assert {(r["qid"], r["id"], r["rank"]) for r in got} == want and all(r["note"] == f"n{r['id']}" for r in got)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        assert vectors.skipped_share(vectors.candidates(corpus, "id", "v", q, "qid", "c", 5)) > 0.5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def star(spark, leaves):
    pairs = [("hub", f"leaf{i:04d}") for i in range(leaves)] + [("leaf0003", "far"), (None, "x"), ("hub", None)]
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src string, dst string")


@pytest.mark.parametrize("total,want", [(None, 102), (1, 1), (2, 2), (50, 50), (101, 101), (102, 102), (500, 102)])
def test_expansion_is_bounded_in_all(spark, total, want):
    """Nearer nodes first, within a hop by name; the bound holds at every border."""
    seeds = spark.createDataFrame([("hub",), (None,)], "node string")
    got = [(r["hop"], r["node"]) for r in graph.bfs(seeds, star(spark, 100), max_total=total, hub=10).collect()]
    order = [(0, "hub"), *((1, f"leaf{i:04d}") for i in range(100)), (2, "far")]
    assert sorted(got) == order[:want]


def test_hub_edges_are_spread(spark):
    edges, hubs = graph.salted(star(spark, 1000), hub=50)
    assert [(r["node"], r["salts"]) for r in hubs.collect()] == [("hub", 20)]
    sizes = edges.groupBy("src", "salt").count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * 50 and edges.count() == 2002
