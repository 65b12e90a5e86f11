"""Table-driven comparator cases (equal, permuted, reordered, duplicates, NULLs,
1 vs 1.0 vs true, 1e-7 differences, empties, arity, 7+ columns, NaN)."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import compare as cmp

S2 = "a string, b long"


def df(spark, rows, schema=S2):
    return spark.createDataFrame(rows, schema)


CASES = [
    ("equal", [("x", 1), ("y", 2)], [("x", 1), ("y", 2)], S2, S2, True),
    ("reordered_rows", [("x", 1), ("y", 2)], [("y", 2), ("x", 1)], S2, S2, True),
    ("duplicate_removed", [("x", 1), ("x", 1)], [("x", 1)], S2, S2, False),
    ("duplicate_kept", [("x", 1), ("x", 1)], [("x", 1), ("x", 1)], S2, S2, True),
    ("missing_row", [("x", 1), ("y", 2)], [("x", 1)], S2, S2, False),
    ("null_cells", [(None, 1), ("y", None)], [(None, 1), ("y", None)], S2, S2, True),
    ("null_vs_value", [(None, 1)], [("", 1)], S2, S2, False),
    ("int_vs_double", [("x", 1)], [("x", 1.0)], S2, "a string, b double", True),
    ("bool_vs_int", [("x", True)], [("x", 1)], "a string, b boolean", S2, True),
    ("tiny_diff", [("x", 1.0)], [("x", 1.0000001)], "a string, b double", "a string, b double", True),
    ("small_diff", [("x", 1.0)], [("x", 1.00001)], "a string, b double", "a string, b double", False),
    ("text_vs_number", [("1", 1)], [(1, 1)], S2, "a long, b long", False),
]


@pytest.mark.parametrize("name,g,p,gs,ps,expect", CASES, ids=[c[0] for c in CASES])
def test_result_eq(spark, name, g, p, gs, ps, expect):
    assert cmp.result_eq(df(spark, g, gs), df(spark, p, ps)) is expect


def test_permuted_columns(spark):
    g = df(spark, [("x", 1), ("y", 2)])
    p = g.select("b", "a")
    assert cmp.result_eq(g, p)


def test_empty_cases(spark):
    e = df(spark, [])
    one = df(spark, [("x", 1)])
    assert cmp.result_eq(e, df(spark, []))
    assert not cmp.result_eq(e, one)
    assert not cmp.result_eq(one, e)
    assert not cmp.result_eq(one, None)


def test_arity(spark):
    g = df(spark, [("x", 1)])
    assert not cmp.result_eq(g, g.withColumn("c", F.lit(1)))


def test_seven_columns_permuted(spark):
    """Columns match by value at any width; a limit on the width is a parameter."""
    cols = ", ".join(f"c{i} long" for i in range(7))
    g = spark.createDataFrame([tuple(range(7)), tuple(range(10, 17))], cols)
    other = g.select(*reversed(g.columns))
    assert cmp.result_eq(g, g) and cmp.result_eq(g, other)
    assert not cmp.result_eq(g, other, permute_up_to=6)


def test_wide_prediction_contains_narrow_gold(spark):
    g = spark.createDataFrame([(1, "a")], "k long, s string")
    p = spark.createDataFrame([(9, 8, 7, 6, 5, "a", 1)], "a long, b long, c long, d long, e long, f string, g long")
    assert cmp.contains(g, p)


def test_equal_columns_are_one_class(spark):
    """Ten equal columns are one map, not ten factorial."""
    cols = ", ".join(f"c{i} long" for i in range(10))
    g = spark.createDataFrame([(1,) * 10, (2,) * 10], cols)
    bounds = {(i, j): 2 for i in range(10) for j in range(10)}
    assert len(list(cmp.best_first(bounds, dict.fromkeys(range(10), "same"), 10, 0))) == 1
    assert cmp.result_eq(g, g) and cmp.soft_f1(g, g) == 1.0


def test_large_integers_are_exact(spark):
    a = spark.createDataFrame([(2**53,)], "x long")
    b = spark.createDataFrame([(2**53 + 1,)], "x long")
    assert cmp.result_eq(a, a) and not cmp.result_eq(a, b)


def test_numbers_of_any_type_are_equal(spark):
    one = [spark.sql(f"SELECT {x} AS x") for x in ("1", "1L", "CAST(1 AS DOUBLE)", "1.000", "true", "CAST(1 AS FLOAT)")]
    assert all(cmp.result_eq(one[0], o) for o in one)
    zero = [spark.sql(f"SELECT {x} AS x") for x in ("0", "CAST('-0.0' AS DOUBLE)", "0.0000000001", "CAST(-1e-9 AS DOUBLE)")]
    assert all(cmp.result_eq(zero[0], z) for z in zero)
    assert not cmp.result_eq(spark.sql("SELECT 10 AS x"), spark.sql("SELECT 1 AS x"))
    assert cmp.result_eq(spark.sql("SELECT 100 AS x"), spark.sql("SELECT CAST(1e2 AS DOUBLE) AS x"))


def test_cells_are_never_joined_into_text(spark):
    sep = "\u001f"
    a = spark.createDataFrame([(f"x{sep}s:y", "z")], "a string, b string")
    b = spark.createDataFrame([("x", f"y{sep}s:z")], "a string, b string")
    assert cmp.bag_diff(cmp.normalise(a), cmp.normalise(b)).count() == 2
    assert not cmp.result_eq(a, b)


def test_six_columns_permuted(spark):
    cols = ", ".join(f"c{i} long" for i in range(6))
    g = spark.createDataFrame([tuple(range(6)), tuple(range(10, 16))], cols)
    assert cmp.result_eq(g, g.select(*reversed(g.columns)))


def test_nan_never_matches(spark):
    g = spark.createDataFrame([("x", float("nan"))], "a string, b double")
    assert not cmp.result_eq(g, g)


def test_ordered(spark):
    g = spark.createDataFrame([(1, "x"), (2, "y")], "pos long, a string")
    same = spark.createDataFrame([(2, "y"), (1, "x")], "pos long, a string")
    swapped = spark.createDataFrame([(1, "y"), (2, "x")], "pos long, a string")
    assert cmp.result_eq(g, same, order_matters=True, pos="pos")
    assert not cmp.result_eq(g, swapped, order_matters=True, pos="pos")
    assert cmp.result_eq(g.drop("pos"), swapped.drop("pos"))


def test_soft_f1(spark):
    g = df(spark, [("x", 1), ("y", 2), ("z", 3), ("z", 3)])
    p = df(spark, [("x", 1), ("z", 3), ("w", 9)])
    assert cmp.soft_f1(g, p) == pytest.approx(2 * 2 / 7)
    assert cmp.soft_f1(g, p.select("b", "a")) == pytest.approx(2 * 2 / 7)   # best permutation
    assert cmp.soft_f1(df(spark, []), df(spark, [])) == 1.0
    assert cmp.soft_f1(g, df(spark, [])) == 0.0
    assert cmp.soft_f1(g, None) == 0.0
    assert cmp.soft_f1(g, g.withColumn("c", F.lit(1))) == 0.0


def test_contains(spark):
    g = df(spark, [("x", 1), ("y", 2)])
    p = spark.createDataFrame([(10.5, 1, "x"), (3.0, 2, "y"), (1.0, 3, "z")], "t double, n long, s string")
    assert cmp.contains(g, p)
    assert not cmp.contains(df(spark, [("q", 1)]), p)


def test_contains_rows_not_columns(spark):
    """Gold columns hidden among wider, reordered prediction columns (with a
    NULL cell) are found; a row present column-wise but not as a row is rejected."""
    g = spark.createDataFrame([(1, "a", None), (2, "b", 5.0)], "k long, s string, v double")
    p = spark.createDataFrame([(5.0, "b", 9, 2, "u"), (None, "a", 8, 1, "w"), (7.0, "c", 7, 3, "v")],
                              "v double, s string, z long, k long, t string")
    assert cmp.contains(g, p)
    mixed = spark.createDataFrame([(5.0, "a", 9, 2, "u"), (None, "b", 8, 1, "w")],
                                  "v double, s string, z long, k long, t string")
    assert not cmp.contains(g, mixed)


# -- many questions at once -------------------------------------------------------------

def most_common(gold, pred, width):
    """Brute force: the most rows in common under any one-to-one map of columns."""
    g, best = Counter(gold), 0
    for places in itertools.permutations(range(len(pred[0])), width):
        best = max(best, sum((g & Counter(tuple(r[i] for i in places) for r in pred)).values()))
    return best


def results(spark, by_question):
    rows = [(q, list(r), None) for q, found in by_question.items() for r in found]
    return spark.createDataFrame(rows, "qid string, cells array<string>, pos long")


def asked(spark, names):
    return spark.createDataFrame([(n, True) for n in names], "qid string, answered boolean")


def cells(rng, rows, width, values="01"):
    return [tuple(rng.choice(values) for _ in range(width)) for _ in range(rows)]


@pytest.mark.parametrize("many", [1 << 16, 30])
def test_soft_f1_equals_brute_force(spark, monkeypatch, many):
    """Five columns of 0 and 1 with nothing to tell them apart; with few maps a job, maps
    grow column by column instead."""
    monkeypatch.setattr(cmp, "MANY", many)
    rng = random.Random(5)
    gold = {f"q{n}": cells(rng, 40, 5) for n in range(6)}
    pred = {q: cells(rng, 30 + 3 * n, 5) for n, q in enumerate(gold)}
    pred["q1"] = [tuple(reversed(r)) for r in gold["q1"]]
    pred["q2"] = [(r[1], r[0], *r[2:4], None) for r in gold["q2"]]
    got = {r.qid: r for r in cmp.judge(asked(spark, gold), results(spark, gold), results(spark, pred), "most").collect()}
    for q in gold:
        common = most_common(gold[q], pred[q], 5)
        assert got[q].common == common
        assert got[q].soft_f1 == pytest.approx(2 * common / (len(gold[q]) + len(pred[q])))
    assert got["q1"].verdict and not got["q0"].verdict


def jobs(spark, run):
    """What ``run`` gives, and the number of SQL executions it took."""
    start = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = run()
    return found, spark._jsparkSession.sharedState().statusStore().executionsCount() - start


def test_eight_binary_columns_in_few_jobs(spark):
    rng = random.Random(8)
    gold, pred = {"q": cells(rng, 60, 8)}, {"q": cells(rng, 60, 8)}
    found, n = jobs(spark, lambda: cmp.judge(asked(spark, ["q"]), results(spark, gold), results(spark, pred), "most").first())
    assert found.common == most_common(gold["q"], pred["q"], 8) and n <= 10


@pytest.mark.parametrize("many", [1 << 16, 50])
def test_four_gold_columns_in_twelve(spark, monkeypatch, many):
    monkeypatch.setattr(cmp, "MANY", many)
    rng = random.Random(12)
    pred = {q: cells(rng, 25, 12) for q in ("in", "lacks", "no")}
    gold = {q: [tuple(r[i] for i in (11, 3, 7, 0)) for r in rows[:20]] for q, rows in pred.items()}
    gold["no"] = cells(rng, 25, 4)
    pred["lacks"] = [r for r in pred["lacks"] if r != pred["lacks"][3]]
    found, n = jobs(spark, lambda: {r.qid: r.verdict for r in cmp.judge(asked(spark, gold), results(spark, gold),
                                                                        results(spark, pred), "inside").collect()})
    assert found == {q: most_common(gold[q], pred[q], 4) == len(gold[q]) for q in gold} and found["in"]
    assert n <= 20      # four levels more than the direct way


def test_a_hundred_pairs_in_few_jobs(spark):
    rng = random.Random(100)
    gold = {f"q{n}": cells(rng, 20, 4, "abcdef") for n in range(100)}
    pred = {q: [tuple(r[(i + n) % 4] for i in range(4)) for r in rows] for n, (q, rows) in enumerate(gold.items())}
    for n in range(0, 100, 9):
        pred[f"q{n}"][0] = ("x",) * 4
    found, n = jobs(spark, lambda: {r.qid: r.verdict for r in cmp.judge(asked(spark, gold), results(spark, gold),
                                                                        results(spark, pred)).collect()})
    assert found == {f"q{n}": n % 9 != 0 for n in range(100)} and n <= 10


def test_missing_and_empty_answers(spark):
    questions = spark.createDataFrame([("both empty", True), ("missing", False), ("gold only", True), ("pred only", True)],
                                      "qid string, answered boolean")
    gold, pred = results(spark, {"gold only": [("a",)], "missing": [("a",)]}), results(spark, {"pred only": [("a",)]})
    for mode in ("equal", "most"):
        got = {r.qid: (r.verdict, r.soft_f1) for r in cmp.judge(questions, gold, pred, mode).collect()}
        assert {q: v for q, (v, _) in got.items()} == {"both empty": True, "missing": False, "gold only": False, "pred only": False}
    assert {q: f for q, (_, f) in got.items()} == {"both empty": 1.0, "missing": 0.0, "gold only": 0.0, "pred only": 0.0}


def test_bag_diff_statuses(spark):
    a = cmp.normalise(df(spark, [("x", 1), ("x", 1), ("y", 2)]))
    b = cmp.normalise(df(spark, [("x", 1), ("z", 3)]))
    got = {r["status"]: (r["n_left"], r["n_right"]) for r in cmp.bag_diff(a, b).collect()}
    assert got == {"changed": (2, 1), "left_only": (1, 0), "right_only": (0, 1)}


def test_ordered_by_text(spark):
    df = spark.createDataFrame([("SELECT a FROM t ORDER  BY a",), ("select a from t",), ("x order\nby y",)], "q string")
    assert [r[0] for r in df.select(cmp.ordered_by_text(F.col("q"))).collect()] == [True, False, True]


def test_one_question_is_not_read_by_one_task(spark):
    """What belongs to a question of many rows meets them in many tasks, and each row once."""
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                                 "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        rows = spark.range(4000).selectExpr("'q' qid", "array('n:' || id, 's:' || id % 7) cells", "cast(null as long) pos")
        bags = cmp._bags(rows, rows).checkpoint()
        spots = cmp._spots(bags)
        asked = spark.createDataFrame([("q", 1), ("q", 2), ("other", 1)], "qid string, map int")
        shares = cmp._of_questions(bags, spots, asked).groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in shares) == 2 * 8000 and max(r["count"] for r in shares) < 8000
        sides = cmp._sides(spots).first()
        assert (sides.n_gold, sides.n_pred, sides.w_gold, sides.w_pred) == (4000, 4000, 2, 2)
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_equal_results_are_not_written(spark, monkeypatch):
    """Rows of questions with one map by marks are added up in one shuffle, and no others are read for it."""
    written = []
    monkeypatch.setattr(cmp, "materialise", lambda df, keep=cmp.materialise: written.append(keep(df)) or written[-1])
    rng = random.Random(7)
    gold = {q: [(f"n:{i}", rng.choice("ab"), None) for i in range(30)] * 2 for q in ("same", "turned", "longer", "other", "fewer")}
    pred = dict(gold, turned=[r[::-1] for r in gold["turned"]], longer=gold["longer"] + gold["longer"][:1],
                other=[(r[0], "c", None) for r in gold["other"]], fewer=[r[:2] for r in gold["fewer"]])
    found = {r.qid: (r.n_gold, r.n_pred, r.common, r.verdict)
             for r in cmp.judge(asked(spark, gold), results(spark, gold), results(spark, pred)).collect()}
    assert found == {"same": (60, 60, 60, True), "turned": (60, 60, 60, True), "longer": (60, 61, 0, False),
                     "other": (60, 60, 0, False), "fewer": (60, 60, 0, False)}
    assert written and not any("cells" in w.columns for w in written)


@pytest.mark.parametrize("sent", [1 << 17, 0])
def test_equal_by_one_of_many_maps(spark, monkeypatch, sent):
    """Two columns with the same mark, of which only one way round is equal; also if questions are too many to be sent."""
    monkeypatch.setattr(cmp, "SENT", sent)
    rows = [("a", "b", "1"), ("b", "a", "2"), ("a", "a", "3")]
    gold = {"turned": rows, "near": rows, "same": rows, "not": rows}
    pred = {"turned": [(r[2], r[1], r[0]) for r in rows], "near": [("a", "b", "2"), ("b", "a", "1"), ("a", "a", "3")],
            "same": rows, "not": [("a", "b", "1"), ("a", "b", "2"), ("a", "a", "3")]}
    found = {r.qid: r.verdict for r in cmp.judge(asked(spark, gold), results(spark, gold), results(spark, pred)).collect()}
    assert found == {q: most_common(gold[q], pred[q], 3) == 3 for q in gold} and found["turned"] and not found["not"]
