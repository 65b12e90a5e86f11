"""Skew-safe operators against brute-force definitions on small inputs."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import intervals, synth, windows
from quarry.operators.graph import bfs


def _events(spark, n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    base = datetime(2020, 1, 1)
    rows = [(rnd.choice(range(keys)) if rnd.random() < 0.5 else 0,        # key 0 is hot
             base + timedelta(days=rnd.randint(0, 900)), i, float(rnd.randint(1, 50)))
            for i in range(n)]
    return spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, v double")


def _hot_null(spark):
    """Half of the rows have a NULL key, an eighth one key; NULL order values and peers."""
    rnd = random.Random(7)
    base = datetime(2020, 1, 1)
    rows = [(None if i % 2 else (0 if i % 8 == 0 else rnd.randint(1, 40)),
             None if i % 50 == 0 else base + timedelta(days=rnd.randint(0, 300)), i,
             None if i % 31 == 0 else float(rnd.randint(1, 50))) for i in range(4000)]
    return spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, v double").repartition(5)


def _same(got, want):
    key = lambda r: r[0]
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("rows", [_events, _hot_null])
def test_running_sum_equals_plain_window(spark, rows):
    df = rows(spark)
    got = windows.running_sum(df, ["k"], "ts", F.col("v"), "r")
    want = df.withColumn("r", F.sum("v").over(Window.partitionBy("k").orderBy(F.asc_nulls_last("ts"))))
    _same(got.select("id", "r").collect(), want.select("id", "r").collect())


@pytest.mark.parametrize("rows", [_events, _hot_null])
def test_previous_max_equals_plain_window(spark, rows):
    df = rows(spark)
    got = windows.previous_max(df, ["k"], ["ts", "id"], F.col("v"), "m")
    w = (Window.partitionBy("k").orderBy(F.asc_nulls_last("ts"), "id").rowsBetween(Window.unboundedPreceding, -1))
    want = df.withColumn("m", F.max("v").over(w))
    _same(got.select("id", "m").collect(), want.select("id", "m").collect())


def test_hot_null_key_fills_several_ranges(spark):
    """NULL keys are split like any other: no range holds most of them."""
    df = _hot_null(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.ranged(df, [F.asc_nulls_last("k"), F.asc_nulls_last("ts")])
        sizes = [r["count"] for r in got.filter("k IS NULL").groupBy("_range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_overlapping_pairs_brute_force(spark):
    df = _events(spark, 300)
    length = 30 * 86_400_000_000
    got = {r["k"]: r["n_pairs"] for r in
           intervals.count_overlapping_pairs(df, "k", "ts", "id", length).collect()}
    rows = df.collect()
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if a.k == b.k and abs((a.ts - b.ts).total_seconds()) < 30 * 86400:
            want[a.k] = want.get(a.k, 0) + 1
    assert got == want


def test_overlapping_rows_brute_force(spark):
    rnd = random.Random(3)
    base = datetime(2021, 1, 1)
    rows = []
    for i in range(200):
        s = base + timedelta(days=rnd.randint(0, 700))
        e = None if rnd.random() < 0.05 else s + timedelta(days=rnd.randint(1, 40))
        rows.append((rnd.randint(0, 4), s, e, i))
    df = spark.createDataFrame(rows, "k long, s timestamp_ntz, e timestamp_ntz, id long")
    got = {r["id"] for r in intervals.overlapping_rows(df, ["k"], "s", "e", "id").collect()}
    far = datetime(9999, 1, 1)
    srt = sorted(rows, key=lambda r: (r[0], r[1], r[3]))
    want = set()
    for i, r in enumerate(srt):
        prev = [q for q in srt[:i] if q[0] == r[0]]
        if prev and r[1] < max(q[2] or far for q in prev):
            want.add(r[3])
    assert got == want


def test_dense_index_is_dense_per_group(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    out = synth.dense_index(df, ["g"], ["x"])
    per = {r["g"]: sorted(r["ix"]) for r in out.groupBy("g").agg(F.collect_list("_idx").alias("ix")).collect()}
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    for g, ix in per.items():
        assert ix == list(range(sizes[g]))


def test_generation_independent_of_partitioning(spark):
    base = spark.range(0, 20000)
    f = lambda d: d.select("id", synth.uniform("u", 42, F.col("id")).alias("u"),
                           synth.zipf_rank(synth.uniform("z", 42, F.col("id")), 50, 1.6).alias("z"),
                           synth.normal("n", 42, F.col("id")).alias("n"))
    one = sorted(f(base.coalesce(1)).collect())
    many = sorted(f(base.repartition(8)).collect())
    assert one == many
    z = [r["z"] for r in one]
    assert min(z) == 1 and max(z) <= 50 and z.count(1) > z.count(2) > z.count(3)
    us = [r["u"] for r in one]
    assert 0 <= min(us) and max(us) < 1 and abs(sum(us) / len(us) - 0.5) < 0.01


def test_bfs_min_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9)],
                                  "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    got = {r["node"]: r["hop"] for r in bfs(seeds, edges).collect()}
    assert got == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2, 6: 3, 7: 4, 8: 5, 9: 6}


def test_bfs_runs_until_nothing_is_new(spark):
    """A path longer than any fixed hop count, and a hop limit as a parameter."""
    n = 33
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["hop"] for r in bfs(seeds, edges).collect()} == {i: i for i in range(n + 1)}
    assert bfs(seeds, edges, 2).count() == 3


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_numbers_without_exchange_reuse(spark, reuse, adaptive):
    """2 M rows with a payload: the numbers come from one written frame, so they do
    not depend on a second run of the exchange."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(0, 2_000_000, 1, 16).select(F.xxhash64("id").alias("h"), "id", F.repeat(F.lit("x"), 20).alias("p"))
        got = windows.number_rows(df, [F.asc("h"), F.asc("id")])
        n, top, distinct = got.agg(F.count("rank"), F.max("rank"), F.count_distinct("rank")).first()
        assert (n, top, distinct) == (2_000_000,) * 3
        some = got.filter("rank <= 1000").orderBy("rank").select("h").collect()
        assert [r["h"] for r in some] == [r["h"] for r in df.orderBy("h").limit(1000).select("h").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_base26_and_padded_keys_stay_unique(spark):
    from quarry.functions.scalar import base26, hash_int, pad_key
    big = [0, 25, 26, 26**4 - 1, 26**4, 26**4 + 1, 10**6, 1234567, 1234568, 2**53 + 1, 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in big], "x long")
    rows = df.select("x", base26(F.col("x"), 4).alias("b"), pad_key(F.col("x")).alias("p"),
                     hash_int("s", 1, F.col("x")).alias("h")).collect()

    def code(n):
        out = ""
        while n or len(out) < 4:
            out, n = chr(65 + n % 26) + out, n // 26
        return out

    assert [r["b"] for r in rows] == [code(x) for x in big]
    assert [r["p"] for r in rows] == [str(x).zfill(6) for x in big]
    assert max(r["h"] for r in rows) > 2**32 and all(0 <= r["h"] < 2**60 for r in rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_global_row_number_equals_plain_window(spark, parts):
    """Range-partitioned numbering = row_number over one global window, with
    a hot tied grade (a third of the rows), NULL grades and many input splits."""
    rnd = random.Random(11)
    rows = [(i, 50.0 if i % 3 == 0 else (None if i % 17 == 0 else float(rnd.randint(0, 1000)) / 10))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "run long, grade double").repartition(parts)
    order = [F.desc_nulls_last("grade"), F.asc_nulls_last("run")]
    got = windows.global_row_number(df, order).select("rank", "run").collect()
    want = df.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "run").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))


def test_spread_only_narrow_scans(spark):
    """A scan with at least one partition per core is returned as is (no
    shuffle added at scale); a narrower one is spread over every core."""
    from quarry.sources.tables import spread
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, cores * 3)
    assert spread(wide) is wide
    narrow = spark.range(0, 1000, 1, 1)
    out = spread(narrow)
    assert out.rdd.getNumPartitions() == cores * 2
    assert sorted(r[0] for r in out.collect()) == list(range(1000))


def test_pick_index_matches_searchsorted(spark):
    """Inverse-CDF pick = 1 + #thresholds <= u, exact at the thresholds; NULL -> 1."""
    import numpy as np
    cdf = synth.cumulative(synth.zipf_weights(50, 1.6))
    rnd = random.Random(5)
    us = [rnd.random() for _ in range(2000)] + list(cdf[:-1]) + [0.0]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(us)] + [(len(us), None)], "i long, u double")
    got = {r["i"]: r["k"] for r in df.select("i", synth.pick_index(F.col("u"), cdf).alias("k")).collect()}
    want = np.searchsorted(np.array(cdf[:-1]), np.array(us), side="right") + 1
    assert [got[i] for i in range(len(us))] == want.tolist()
    assert got[len(us)] == 1


def test_global_row_number_empty(spark):
    df = spark.createDataFrame([], "run long, grade double")
    assert windows.global_row_number(df, [F.desc_nulls_last("grade"), F.asc_nulls_last("run")]).collect() == []


def test_report_reads_six_tables(spark, sf_dir, monkeypatch):
    """Orders, customers and suppliers are scanned once for all rules, lines three times."""
    from quarry.plans import REGISTRY
    from quarry.sources.tables import Tables
    reads = []
    real = Tables.read
    monkeypatch.setattr(Tables, "read", lambda self, table: reads.append(table) or real(self, table))
    REGISTRY["dq_report"].build(spark, sf_dir).collect()
    assert sorted(reads) == ["customer", "lineitem", "lineitem", "lineitem", "orders", "supplier"]


def test_rules_along_links(spark):
    """A rule two parents up, orphans on each level, NULL keys, and a table that is both checked and a parent."""
    from quarry.operators import quality as dq
    tables = {
        "leaf": spark.createDataFrame([(1, 10, 5), (2, 11, 7), (3, 99, 1), (4, None, 1), (5, 12, 5)], "id long, mid_id long, t long"),
        "mid": spark.createDataFrame([(10, 100, 1), (11, 101, -1), (12, 777, 1)], "mid_id_pk long, top_id long, m long"),
        "top": spark.createDataFrame([(100, 5), (101, 6)], "top_pk long, t_top long")}
    leaf_mid = dq.Link("leaf", "mid_id", "mid", "mid_id_pk", ("m",))
    mid_top = dq.Link("mid", "top_id", "top", "top_pk", ("t_top",))
    rules = [dq.RowRule("other_top", "leaf", lambda: F.col("t") != F.col("t_top"), (leaf_mid, mid_top)),
             dq.RowRule("negative", "mid", lambda: F.col("m") < 0), dq.orphan(leaf_mid), dq.orphan(mid_top),
             dq.RowRule("leaf_negative_mid", "leaf", lambda: F.col("m") < 0, (leaf_mid,))]
    got = {r["rule"]: r["violations"] for r in dq.counts(rules, tables.__getitem__).collect()}
    assert got == {"other_top": 1, "negative": 1, "orphan:leaf_mid": 1, "orphan:mid_top": 1, "leaf_negative_mid": 1}
