"""Scoring jobs: per-question results -> run summaries -> grades -> board.

Input is a results table with one row per (run, question):
``run, qid, ex, error, soft, gen_ms, exec_ms, gold_ms, tokens, shape,
retrieval, model``. Every rollup is a groupBy over runs; the only
whole-table values are the field minima of the grade, taken as scalar
subqueries (one row each, by construction).

Rounded percentages and means are computed from integer counts (and cents
for milliseconds), so half-up rounding is exact rather than subject to
binary ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.windows import global_row_number

# Fixed values the benchmark defines ------------------------------------
SHAPES = ["single", "join", "multi-join", "analytical"]
RETRIEVALS = ["named", "1-hop", "2-hop+", "lexical-gap"]
GRADE_WEIGHTS = [("ex", 0.45), ("eff", 0.20), ("rel", 0.10), ("tok", 0.15), ("lat", 0.10)]
# USD per 1,000,000 tokens (input, output); unknown models use the default.
PRICES = [("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00), ("gpt-4.1-mini", 0.40, 1.60),
          ("gpt-4.1", 2.00, 8.00), ("o4-mini", 1.10, 4.40)]
DEFAULT_PRICE = (2.50, 10.00)
VES_CAP = 3.0
CLAIM_SLACK = 2.0
# -----------------------------------------------------------------------


def round1_ratio(num: Column, den: Column) -> Column:
    """round(num/den, 1) half-up for non-negative integers; NULL when den = 0."""
    num, den = num.cast("long"), den.cast("long")
    return F.when(den > 0, F.floor((F.lit(20) * num + den) / (F.lit(2) * den)) / F.lit(10.0))


def pct1(k: Column, n: Column) -> Column:
    """round(100*k/n, 1): the EX@1-style percentage."""
    return round1_ratio(F.lit(100) * k.cast("long"), n)


def cents(ms: Column) -> Column:
    return F.round(ms * 100).cast("long")


def ves_reward(ex: Column, gold_ms: Column, pred_ms: Column) -> Column:
    """min(3, sqrt(gold/pred)) for a correct answer with both times > 0, else 0;
    NULL (left out of the mean) if the question has no valid gold."""
    ok = ex & (gold_ms > 0) & (pred_ms > 0)
    return F.when(ex.isNull(), None).when(ok, F.least(F.lit(VES_CAP), F.sqrt(gold_ms / pred_ms))).otherwise(F.lit(0.0))


def milli(c: Column) -> Column:
    """A score rounded to three places, as whole thousandths (sums are then exact)."""
    return F.round(c * 1000).cast("long")


def mean_pct1(c: Column) -> Column:
    """round(100 * mean of the rounded scores, 1) over the rows that have one."""
    return round1_ratio(F.sum(milli(c)), F.count(c) * 10)


def ex_rollup(results: DataFrame) -> DataFrame:
    """E-ROLLUP/E-SOFT: EX overall, per shape and per retrieval, mean soft-F1,
    in one pass of conditional aggregates. A question whose gold failed has a
    NULL outcome and is in no denominator; an empty bucket is NULL."""
    aggs = [pct1(F.count_if("ex"), F.count("ex")).alias("ex_at_1"), mean_pct1(F.col("soft")).alias("soft_f1")]
    for col, values in (("shape", SHAPES), ("retrieval", RETRIEVALS)):
        for v in values:
            inb = F.col(col) == v
            name = "ex_" + v.replace("-", "_").replace("+", "_plus")
            aggs.append(pct1(F.count_if(inb & F.col("ex")), F.count_if(inb & F.col("ex").isNotNull())).alias(name))
    return results.groupBy("run").agg(*aggs)


SUMMARY_COLUMNS = ["run", "n", "errors", "ex_at_1", "ves", "avg_gen_ms", "avg_exec_ms", "avg_total_ms",
                   "avg_gold_ms", "total_tokens", "avg_tokens", "token_coverage"]

#: Aggregates of columns that results may lack.
_OPTIONAL = {"soft", "set_recall", "prompt", "completion", "claimed"}


def _sums(columns: list[str]) -> dict[str, Column]:
    """The counts and whole-number sums that every rate is made of; any of them may be
    summed again over a coarser key."""
    total_c = F.coalesce(cents(F.col("gen_ms")), F.lit(0)) + F.coalesce(cents(F.col("exec_ms")), F.lit(0))
    ves = ves_reward(F.col("ex"), F.col("gold_ms"), F.col("exec_ms"))
    found = {"n": F.count(F.lit(1)), "errors": F.count_if("error"), "right": F.count_if("ex"), "judged": F.count("ex"),
             "ves_sum": F.sum(milli(ves)), "ves_n": F.count(ves), "total_sum": F.sum(total_c),
             "token_sum": F.sum("tokens"), "token_n": F.count("tokens")}
    for ms in ("gen", "exec", "gold"):
        found |= {f"{ms}_sum": F.sum(cents(F.col(f"{ms}_ms"))), f"{ms}_n": F.count(f"{ms}_ms")}
    more = {"soft": {"soft_sum": F.sum(milli(F.col("soft"))), "soft_n": F.count("soft")},
            "set_recall": {"recall_right": F.count_if("set_recall"), "recall_n": F.count("set_recall")},
            "prompt": {"prompt": F.coalesce(F.sum("prompt"), F.lit(0))},
            "completion": {"completion": F.coalesce(F.sum("completion"), F.lit(0))},
            "claimed": {"claimed": F.count_if("claimed")}}
    for name in sorted(_OPTIONAL & set(columns)):
        found |= more[name]
    return found


def partial_sums(results: DataFrame, *keys: str) -> DataFrame:
    """One row per key: what ``rates`` needs, in one hash aggregate (fixed-width buffers)."""
    return results.groupBy(*keys).agg(*[c.alias(name) for name, c in _sums(results.columns).items()])


def add_up(partial: DataFrame, *keys: str) -> DataFrame:
    """``partial_sums`` over a coarser key."""
    known = set(_sums(list(_OPTIONAL)))
    return partial.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in partial.columns if c in known])


def rates(sums: DataFrame, *keep: str) -> DataFrame:
    """Run summary of ``partial_sums`` per run: n, errors, EX, VES, latency means, token stats, and
    soft-F1, Set-Recall, claimed EX, prompt and completion tokens where the sums have them."""
    mean = lambda name, scale: round1_ratio(F.col(f"{name}_sum"), F.col(f"{name}_n") * scale)
    out = [F.col("run"), F.col("n"), F.col("errors"), pct1(F.col("right"), F.col("judged")).alias("ex_at_1"),
           mean("ves", 10).alias("ves"), mean("gen", 100).alias("avg_gen_ms"), mean("exec", 100).alias("avg_exec_ms"),
           round1_ratio(F.col("total_sum"), F.col("n") * 100).alias("avg_total_ms"),
           mean("gold", 100).alias("avg_gold_ms"), F.col("token_sum").alias("total_tokens"),
           mean("token", 1).alias("avg_tokens"),
           F.concat_ws("/", F.col("token_n").cast("string"), F.col("n").cast("string")).alias("token_coverage")]
    have = set(sums.columns)
    if "soft_n" in have:
        out.append(mean("soft", 10).alias("soft_f1"))
    if "recall_n" in have:
        out.append(pct1(F.col("recall_right"), F.col("recall_n")).alias("set_recall"))
    if "claimed" in have:
        out.append(pct1(F.col("claimed"), F.col("n")).alias("claimed_ex"))
    out += [F.col(c).alias(f"{c}_tokens") for c in ("prompt", "completion") if c in have]
    return sums.select(*out, *keep)


def summarise(results: DataFrame) -> DataFrame:
    """The run summary straight from the results."""
    return rates(partial_sums(results, "run"))


def field_minima(df: DataFrame, cols: list[str]) -> Column:
    """Smallest non-zero value of each column over all runs: ONE scalar
    subquery (a partial-aggregated global aggregate) returning a struct."""
    return df.agg(F.struct(*[F.min(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in cols])).scalar()


def _cap100(v: Column) -> Column:
    # least() would turn a NULL dimension into 100; this keeps NULL as NULL.
    return F.when(v > 100.0, F.lit(100.0)).otherwise(v)


def grade(summary: DataFrame) -> DataFrame:
    """E-GRADE: five dimensions, absent ones dropped and weights renormalised."""
    # One column holds the minima struct, so the scalar subquery is planned
    # once rather than once per reference.
    summary = summary.withColumn("_m", field_minima(summary, ["avg_tokens", "avg_total_ms"]))
    m = F.col("_m")
    d = summary.select(
        "run",
        F.col("ex_at_1").alias("ex"),
        _cap100(F.col("ves")).alias("eff"),
        pct1(F.col("n") - F.col("errors"), F.col("n")).alias("rel"),
        _cap100(F.when(F.col("avg_tokens") > 0, 100.0 * m["avg_tokens"] / F.col("avg_tokens"))).alias("tok"),
        _cap100(F.when(F.col("avg_total_ms") > 0, 100.0 * m["avg_total_ms"] / F.col("avg_total_ms"))).alias("lat"),
    )
    return d.withColumn("grade", weighted_grade())


def weighted_grade() -> Column:
    num = F.lit(0.0)
    den = F.lit(0.0)
    for name, w in GRADE_WEIGHTS:
        num = num + F.coalesce(F.lit(w) * F.col(name), F.lit(0.0))
        den = den + F.when(F.col(name).isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(den > 0, F.round(num / den, 1))


def leaderboard(graded: DataFrame, rejected: DataFrame) -> DataFrame:
    """E-BOARD: rejected runs dropped, grade desc (NULL last), ranks 1..n.
    One row per run; the number of runs grows with the input, so ranks come
    from the range-partitioned ``global_row_number``, not a one-task window."""
    rej = rejected.select(F.col("run").alias("_rej")).distinct()
    kept = graded.join(rej, graded["run"].eqNullSafe(rej["_rej"]), "left_anti")
    ranked = global_row_number(kept.select("run", "grade"), [F.desc_nulls_last("grade"), F.asc_nulls_last("run")])
    return ranked.select("rank", "run", "grade")


def price_table(spark, prices=PRICES) -> DataFrame:
    return spark.createDataFrame(prices, "prefix string, price_in double, price_out double")


def longest_prefix_price(df: DataFrame, name: Column, prices: DataFrame) -> DataFrame:
    """E-COST pricing: the longest key ``name`` starts with, as an equi-join.

    Prices depend on the name only, so each distinct name is priced once:
    every prefix of it (up to the longest key, a scalar subquery over the
    price table) is generated and equi-joined
    to the keys, the longest hit wins, and the result joins back on the name
    value. Deterministic under recomputation (no generated row ids).
    Adds ``prefix, price_in, price_out`` (NULL when no key matches).
    """
    keyed = df.withColumn("_name", name)
    names = keyed.select("_name").distinct()
    longest_key = prices.agg(F.max(F.length("prefix"))).scalar()
    cand = names.select("_name", F.explode(F.sequence(F.lit(1), F.least(F.length("_name"), longest_key)))
                        .alias("_len")).select("_name", "_len", F.expr("substring(_name, 1, _len)").alias("prefix"))
    hits = cand.join(prices, "prefix").groupBy("_name").agg(
        F.max_by(F.struct("prefix", "price_in", "price_out"), "_len").alias("_p"))
    return (keyed.join(hits, "_name", "left")
            .select(*df.columns, "_p.prefix", "_p.price_in", "_p.price_out"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k = 1 - C(n-c, k)/C(n, k) = 1 - prod_{i<k} (n-c-i)/(n-i); NULL if n < k."""
    prod = F.lit(1.0)
    for i in range(k):                         # unrolled: k is fixed, the product stays in codegen
        prod = prod * ((n - c - i) / (n - i))
    return F.when(n >= k, F.lit(1.0) - prod)


def prefix_price_columns(name: Column, prices=PRICES, default=DEFAULT_PRICE) -> tuple[Column, Column]:
    """Longest-prefix pricing against a fixed, small key list: a CASE chain
    over keys sorted longest first -- no join, no shuffle."""
    keys = sorted(prices, key=lambda p: -len(p[0]))
    pin, pout = F.lit(default[0]), F.lit(default[1])
    for k, a, b in reversed(keys):
        pin = F.when(name.startswith(k), F.lit(a)).otherwise(pin)
        pout = F.when(name.startswith(k), F.lit(b)).otherwise(pout)
    return pin, pout
