"""Hand-checked scoring numbers and plug-in error capture."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import scoring as sc


def test_published_grade(spark):
    # Two tools whose field minima are the published anchors (tokens 1999.9, latency 1406.3).
    rows = [("tool_a", 100, 0, 72.0, 72.0, 4689.0, 2547.8),
            ("anchor", 100, 0, 10.0, 10.0, 1999.9, 1406.3)]
    s = spark.createDataFrame(rows, "run string, n long, errors long, ex_at_1 double, ves double, "
                                    "avg_tokens double, avg_total_ms double")
    g = {r["run"]: r["grade"] for r in sc.grade(s).collect()}
    assert g["tool_a"] == 68.7


def test_grade_renormalises_missing_dims(spark):
    s = spark.createDataFrame([("a", 10, 0, 50.0, None, None, None)],
                              "run string, n long, errors long, ex_at_1 double, ves double, "
                              "avg_tokens double, avg_total_ms double")
    r = sc.grade(s).first()
    assert r["grade"] == round((0.45 * 50 + 0.10 * 100) / 0.55, 1)


def test_pct1_exact_half_up(spark):
    df = spark.createDataFrame([(1, 16), (1, 8), (0, 0), (2, 3)], "k long, n long")
    got = [r[0] for r in df.select(sc.pct1(F.col("k"), F.col("n"))).collect()]
    assert got == [6.3, 12.5, None, 66.7]


def test_ves_reward(spark):
    df = spark.createDataFrame([(True, 50.0, 50.0), (True, 50.0, 1.0), (False, 50.0, 1.0), (True, 0.0, 1.0)],
                               "ex boolean, g double, p double")
    got = [r[0] for r in df.select(sc.ves_reward(F.col("ex"), F.col("g"), F.col("p"))).collect()]
    assert got == [1.0, 3.0, 0.0, 0.0]


def test_pass_at_k(spark):
    from math import comb
    df = spark.createDataFrame([(10, 3), (10, 0), (5, 5), (3, 1)], "n long, c long")
    got = [r[0] for r in df.select(sc.pass_at_k(F.col("n"), F.col("c"), 5)).collect()]
    assert got[0] == pytest.approx(1 - comb(7, 5) / comb(10, 5))
    assert got[1] == pytest.approx(0.0)
    assert got[2] == pytest.approx(1.0)
    assert got[3] is None


def test_longest_prefix_price(spark):
    df = spark.createDataFrame([("gpt-4o-mini-2024",), ("gpt-4o",), ("gpt-4.1-mini",), ("mystery",)], "m string")
    pin, pout = sc.prefix_price_columns(F.col("m"))
    got = [(r[0], r[1]) for r in df.select(pin, pout).collect()]
    assert got == [(0.15, 0.60), (2.50, 10.00), (0.40, 1.60), (2.50, 10.00)]
    prices = sc.price_table(spark)
    j = {r["m"]: r["prefix"] for r in sc.longest_prefix_price(df, F.col("m"), prices).collect()}
    assert j == {"gpt-4o-mini-2024": "gpt-4o-mini", "gpt-4o": "gpt-4o", "gpt-4.1-mini": "gpt-4.1-mini",
                 "mystery": None}


def test_predictor_errors_are_rows(spark):
    from quarry.plans.io import run_predictor
    q = spark.createDataFrame([(i, i % 2) for i in range(20)], "qid long, quality int")

    def flaky(pdf):
        if (pdf.qid == 7).any():
            raise RuntimeError("boom")
        return pdf.assign(answer=pdf.quality)[["answer"]]

    out = {r["qid"]: r for r in run_predictor(q, flaky, "qid").collect()}
    assert len(out) == 20
    assert out[7]["error"].startswith("RuntimeError") and out[7]["answer"] is None
    assert all(out[i]["error"] is None and out[i]["answer"] == i % 2 for i in out if i != 7)


def test_failed_gold_is_left_out(spark):
    """One right answer and one question without a valid gold: EX, VES and F1 are of one question."""
    rows = [(1, 1, True, False, 1.0, 10.0, 50.0, 50.0, 5, "single", "named", "m"),
            (1, 2, None, False, None, 10.0, 50.0, 50.0, 5, "join", "named", "m")]
    df = spark.createDataFrame(rows, "run long, qid long, ex boolean, error boolean, soft double, gen_ms double, "
                                     "exec_ms double, gold_ms double, tokens long, shape string, retrieval string, model string")
    s = sc.summarise(df).first()
    assert (s["n"], s["ex_at_1"], s["ves"]) == (2, 100.0, 100.0)
    r = sc.ex_rollup(df).first()
    assert (r["ex_at_1"], r["soft_f1"], r["ex_single"], r["ex_join"], r["ex_named"]) == (100.0, 100.0, 100.0, None, 100.0)


def test_scores_are_rounded_per_question(spark):
    """Two thirds is 0.667 per question, so the mean of one is 66.7 and sums are exact."""
    df = spark.createDataFrame([(2 / 3,), (None,), (0.0,), (1.0,)], "soft double")
    assert df.agg(sc.mean_pct1(F.col("soft"))).first()[0] == 55.6


def test_coverage_of_many_questions(spark):
    """More than 64 questions, one missing in a run, an unknown one in another."""
    from quarry.plans.scoring import coverage_issues
    n = 150
    rows = [("all", q, True) for q in range(n)] + [("short", q, False) for q in range(n - 1)]
    rows += [("odd", q, False) for q in range(n)] + [("odd", 999, False)] + [(None, 3, False)]
    df = spark.createDataFrame(rows, "run string, question long, right boolean")
    official = spark.range(n).withColumnRenamed("id", "question")
    got = {(r["run"], r["issue"]) for r in coverage_issues(df, official).collect()}
    assert got == {("short", "missing_ids"), ("odd", "unknown_ids"), (None, "missing_ids")}


def test_missing_model_and_tokens_are_accepted(spark):
    from quarry.plans.scoring import issues_from
    per = spark.createDataFrame([("a", None, 50.0, 50.0, None, 0), ("b", "other", 50.0, 50.0, 5, 5),
                                 ("c", "gpt-4o", 60.0, 50.0, 0, 0)],
                                "run string, model string, claimed_ex double, ex_at_1 double, total_tokens long, prompt_tokens long")
    pairs = spark.createDataFrame([(r, 1) for r in "abc"], "run string, question long")
    got = {(r["run"], r["issue"]) for r in issues_from(per, pairs, pairs.select("question").distinct()).collect()}
    assert got == {("b", "other_model"), ("c", "inflated_claim"), ("c", "zero_tokens")}


def test_long_error_text_is_kept(spark):
    from quarry.plans.io import run_predictor
    q = spark.createDataFrame([(i, 0) for i in range(9)], "qid long, quality int")

    def bad(pdf):
        if (pdf.qid % 4 == 1).any():
            raise ValueError("e" * 3000)
        return pdf.assign(answer=pdf.quality)[["answer"]]

    out = {r["qid"]: r["error"] for r in run_predictor(q, bad, "qid").collect()}
    assert sorted(i for i, e in out.items() if e) == [1, 5] and len(out[1]) == 3000 + len("ValueError: ")


def test_sums_add_up(spark, sf_dir):
    """Rates of sums per (run, question) added up equal the rates straight from the rows."""
    from quarry.plans.scoring import submitted_rows
    from quarry.sources.tables import Tables
    rows = submitted_rows(Tables(spark, sf_dir))
    straight = sc.rates(sc.partial_sums(rows, "run"))
    twice = sc.rates(sc.add_up(sc.partial_sums(rows, "run", "question"), "run"))
    assert sorted(map(tuple, straight.collect())) == sorted(map(tuple, twice.collect()))


@pytest.mark.parametrize("name", ["leaderboard", "validate_runs", "export_csv", "rescore_runs", "token_rollup"])
def test_events_are_scanned_once(spark, sf_dir, name, tmp_path, monkeypatch):
    """Only the per-question sums read the events; all else reads what they wrote."""
    from quarry.plans import REGISTRY
    from quarry.sources.tables import Tables
    reads = []
    real = Tables.read
    monkeypatch.setattr(Tables, "read", lambda self, table: reads.append(table) or real(self, table))
    REGISTRY[name].build(spark, sf_dir).count()
    assert reads.count("events") == 1


def test_null_run_is_scored(spark):
    """A run without an id is one run, not lost."""
    from quarry.plans.scoring import verified
    rows = [(None, "gpt-4o", 1, True, False, 10.0, 50.0, 50.0, 5, 4), (7, "gpt-4o", 1, False, True, 10.0, 50.0, 50.0, 5, 4)]
    df = spark.createDataFrame(rows, "run long, model string, question long, ex boolean, error boolean, gen_ms double, "
                                     "exec_ms double, gold_ms double, tokens long, prompt long")
    df = df.withColumn("completion", F.lit(1).cast("long")).withColumn("soft", F.lit(0.0)).withColumn("claimed", F.col("ex"))
    got = {r["run"]: r for r in verified(sc.partial_sums(df, "run", "model", "question")).collect()}
    assert got.keys() == {None, 7} and got[None]["ex_at_1"] == 100.0 and got[7]["errors"] == 1


def test_predictor_keeps_null_ids_and_payload(spark):
    """NULL and text ids, a carried column, a plug-in that fails, and one that answers too few."""
    from quarry.plans.io import run_predictor
    q = spark.createDataFrame([(None, 1, "x"), (3, 0, "y"), (None, 2, "z")], "qid long, quality int, note string")

    def flaky(pdf):
        if (pdf.quality == 2).any():
            raise RuntimeError("boom")
        return pd.DataFrame({"answer": pdf.quality})

    got = sorted(map(tuple, run_predictor(q, flaky, "qid", ("note",)).select("qid", "note", "answer", "error").collect()), key=str)
    assert got == sorted([(None, "x", 1, None), (3, "y", 0, None), (None, "z", None, "RuntimeError: boom")], key=str)
    texts = q.selectExpr("cast(qid as string) as qid", "quality")
    assert run_predictor(texts, flaky, "qid").filter("error is null").count() == 2
    short = run_predictor(q, lambda pdf: pdf.iloc[:0], "qid").collect()
    assert len(short) == 3 and all(r["error"].startswith("ValueError") for r in short)
