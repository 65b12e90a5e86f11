"""Scoring and leaderboard jobs over run rows derived from events.

Crosswalk: run = user_id, question = event_id, correct = purchase,
error = error event, exec time = value, generation time = 10 * props.k,
tokens = metered 50 * props.k (not metered on views) else self-reported
floor(value); shape/retrieval buckets cycle by event_id; the model cycles
over the price keys by run. A run answers questions 0 to 14 in turn (some of
its rows name a question that does not exist); the official questions are the
first 15 nations. A run claims a row if its value is above 250, names
prompt and completion tokens on some rows, and a set of tables on most.

Everything on a board comes from one aggregate of the events per (run, model,
question), which is written and added up per run.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from quarry.operators import scoring as sc
from quarry.plans.registry import query
from quarry.session import materialise
from quarry.sources.tables import Tables

MODELS = ["gpt-4o", "gpt-4o-mini", "gpt-4.1", "gpt-4.1-mini", "o4-mini", "openai/gpt-4o", "local-model"]
BOARD_MODEL = "gpt-4o"
PASS_K = 5
GOLD_FAILS = 40      # every 40th question's gold query fails: its outcome is NULL


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


QUESTIONS = 15
TABLE_SET = ["customers", "orders", "payments", "shipments"]


def run_rows(t: Tables):
    e = t.events
    k = F.get_json_object("props", "$.k").cast("long")
    et, i = F.col("event_type"), F.col("event_id")
    gold_ok = F.coalesce(i % GOLD_FAILS != 0, F.lit(True))
    tables = _lit_array(TABLE_SET)
    return e.select(
        F.col("user_id").alias("run"), i.alias("qid"),
        F.when(i % 211 == 7, 100 + i % 3).otherwise(i % QUESTIONS).alias("question"),
        F.when(gold_ok, et == "purchase").alias("ex"), (et == "error").alias("error"),
        F.when(gold_ok, F.when(et == "purchase", 1.0).when(et == "click", F.lit(2) / F.lit(3)).otherwise(0.0))
        .alias("soft"),
        (k * 10).cast("double").alias("gen_ms"),
        F.col("value").alias("exec_ms"), F.lit(50.0).alias("gold_ms"),
        F.coalesce(F.when(et != "view", k * 50), F.floor("value").cast("long")).alias("tokens"),
        F.when(et != "view", k * 40).alias("prompt"), F.when((et != "view") & (k % 2 == 0), k * 10).alias("completion"),
        F.slice(tables, F.lit(1), (i % 4 + 1).cast("int")).alias("gold_tables"),
        F.when(i % 5 != 0, F.slice(tables, F.lit(1), (F.expr("event_id div 4") % 4 + 1).cast("int"))).alias("pred_tables"),
        F.coalesce(et == "purchase", F.lit(False)).alias("reported"),
        F.get(_lit_array(sc.SHAPES), (i % 4).cast("int")).alias("shape"),
        F.get(_lit_array(sc.RETRIEVALS), (F.expr("event_id div 4") % 4).cast("int"))
        .alias("retrieval"),
        F.get(_lit_array(MODELS), (F.col("user_id") % len(MODELS)).cast("int")).alias("model"),
        (F.col("value") > 250).alias("claimed"),
    )


def official_questions(t: Tables):
    """(question): the questions every run must answer."""
    return t.dim("nation").select(F.col("n_nationkey").cast("long").alias("question")).filter(F.col("question") < QUESTIONS)


def _arr(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RUNS_SQL = f"""runs AS (
  SELECT user_id AS run, event_id AS qid,
         CASE WHEN event_id % 211 = 7 THEN 100 + event_id % 3 ELSE event_id % {QUESTIONS} END AS question,
         CASE WHEN coalesce(event_id % {GOLD_FAILS} <> 0, true) THEN event_type = 'purchase' END AS ex,
         event_type = 'error' AS error,
         CASE WHEN coalesce(event_id % {GOLD_FAILS} <> 0, true) THEN
              CASE WHEN event_type = 'purchase' THEN CAST(1 AS DOUBLE)
                   WHEN event_type = 'click' THEN CAST(2 AS DOUBLE) / 3 ELSE CAST(0 AS DOUBLE) END END AS soft,
         CAST(k * 10 AS DOUBLE) AS gen_ms,
         value AS exec_ms, CAST(50.0 AS DOUBLE) AS gold_ms,
         coalesce(CASE WHEN event_type <> 'view' THEN k * 50 END, CAST(floor(value) AS BIGINT)) AS tokens,
         CASE WHEN event_type <> 'view' THEN k * 40 END AS prompt,
         CASE WHEN event_type <> 'view' AND k % 2 = 0 THEN k * 10 END AS completion,
         CASE WHEN event_id IS NOT NULL THEN {_arr(TABLE_SET)}[1:1 + event_id % 4] END AS gold_tables,
         CASE WHEN event_id % 5 <> 0 THEN {_arr(TABLE_SET)}[1:1 + (event_id // 4) % 4] END AS pred_tables,
         coalesce(event_type = 'purchase', false) AS reported,
         ({_arr(sc.SHAPES)})[event_id % 4 + 1] AS shape,
         ({_arr(sc.RETRIEVALS)})[(event_id // 4) % 4 + 1] AS retrieval,
         ({_arr(MODELS)})[user_id % {len(MODELS)} + 1] AS model,
         value > 250 AS claimed
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def r1(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN floor((20 * ({num}) + ({den})) / (2 * ({den}))) / 10.0 END)"


def p1(k: str, n: str) -> str:
    return r1(f"100 * ({k})", n)


def cents(x: str) -> str:
    return f"CAST(round(({x}) * 100) AS BIGINT)"


def milli(x: str) -> str:
    return f"CAST(round(({x}) * 1000) AS BIGINT)"


VES_SQL = ("CASE WHEN ex IS NULL THEN NULL WHEN ex AND gold_ms > 0 AND exec_ms > 0 "
           "THEN least(CAST(3 AS DOUBLE), sqrt(gold_ms / exec_ms)) ELSE CAST(0 AS DOUBLE) END")

SUMMARY_SQL = RUNS_SQL + f""",
summary AS (
  SELECT run, count(*) AS n, count(*) FILTER (WHERE error) AS errors,
         {p1("count(*) FILTER (WHERE ex)", "count(ex)")} AS ex_at_1,
         {r1(f"sum({milli(VES_SQL)})", f"count({VES_SQL}) * 10")} AS ves,
         {r1(f"sum({cents('gen_ms')})", "count(gen_ms) * 100")} AS avg_gen_ms,
         {r1(f"sum({cents('exec_ms')})", "count(exec_ms) * 100")} AS avg_exec_ms,
         {r1(f"sum(coalesce({cents('gen_ms')}, 0) + coalesce({cents('exec_ms')}, 0))", "count(*) * 100")} AS avg_total_ms,
         {r1(f"sum({cents('gold_ms')})", "count(gold_ms) * 100")} AS avg_gold_ms,
         CAST(sum(tokens) AS BIGINT) AS total_tokens,
         {r1("sum(tokens)", "count(tokens)")} AS avg_tokens,
         CAST(count(tokens) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS token_coverage
  FROM runs GROUP BY run)"""

_GRADED_SQL = f""",
mins AS (SELECT min(CASE WHEN avg_tokens > 0 THEN avg_tokens END) AS mt,
                min(CASE WHEN avg_total_ms > 0 THEN avg_total_ms END) AS ml FROM summary),
d AS (SELECT run, ex_at_1 AS ex, CASE WHEN ves IS NOT NULL THEN least(CAST(100.0 AS DOUBLE), ves) END AS eff, {p1("n - errors", "n")} AS rel,
             CASE WHEN avg_tokens > 0 AND mt IS NOT NULL THEN least(CAST(100.0 AS DOUBLE), CAST(100.0 AS DOUBLE) * mt / avg_tokens) END AS tok,
             CASE WHEN avg_total_ms > 0 AND ml IS NOT NULL THEN least(CAST(100.0 AS DOUBLE), CAST(100.0 AS DOUBLE) * ml / avg_total_ms) END AS lat
      FROM summary, mins),
w AS (SELECT *, {' + '.join(['CAST(0.0 AS DOUBLE)'] + [f'coalesce(CAST({wt} AS DOUBLE) * {nm}, 0.0)' for nm, wt in sc.GRADE_WEIGHTS])} AS num,
             {' + '.join(['CAST(0.0 AS DOUBLE)'] + [f'(CASE WHEN {nm} IS NOT NULL THEN CAST({wt} AS DOUBLE) ELSE 0.0 END)' for nm, wt in sc.GRADE_WEIGHTS])} AS den
      FROM d),
graded AS (SELECT run, ex, eff, rel, tok, lat, CASE WHEN den > 0 THEN round(num / den, 1) END AS grade FROM w)"""

GRADE_SQL = SUMMARY_SQL + _GRADED_SQL


def _price_sql(col: str) -> tuple[str, str]:
    keys = sorted(sc.PRICES, key=lambda p: -len(p[0]))
    cin = " ".join(f"WHEN starts_with({col}, '{k}') THEN {pi}" for k, pi, _ in keys)
    cout = " ".join(f"WHEN starts_with({col}, '{k}') THEN {po}" for k, _, po in keys)
    return (f"CAST(CASE {cin} ELSE {sc.DEFAULT_PRICE[0]} END AS DECIMAL(6, 2))",
            f"CAST(CASE {cout} ELSE {sc.DEFAULT_PRICE[1]} END AS DECIMAL(6, 2))")


_VIN, _VOUT = _price_sql("model")

#: The verified numbers of each run, as ``summary``.
VERIFIED_SQL = RUNS_SQL + f""",
scored AS (
  SELECT *, CASE WHEN pred_tables IS NOT NULL THEN list_has_all(pred_tables, gold_tables) ELSE reported END AS set_recall,
         CASE WHEN prompt IS NOT NULL OR completion IS NOT NULL THEN coalesce(prompt, 0) + coalesce(completion, 0) END AS toks
  FROM runs),
agg AS (
  SELECT run, replace(min(model), 'openai/', '') AS model, count(*) AS n, count(*) FILTER (WHERE error) AS errors,
         {p1("count(*) FILTER (WHERE ex)", "count(ex)")} AS ex_at_1,
         {r1(f"sum({milli(VES_SQL)})", f"count({VES_SQL}) * 10")} AS ves,
         {r1(f"sum({milli('soft')})", "count(soft) * 10")} AS soft_f1,
         {p1("count(*) FILTER (WHERE set_recall)", "count(set_recall)")} AS set_recall,
         {r1(f"sum({cents('gen_ms')})", "count(gen_ms) * 100")} AS avg_gen_ms,
         {r1(f"sum({cents('exec_ms')})", "count(exec_ms) * 100")} AS avg_exec_ms,
         {r1("sum(toks)", "count(toks)")} AS avg_tokens, CAST(sum(toks) AS BIGINT) AS total_tokens,
         CAST(count(toks) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS token_coverage,
         CAST(coalesce(sum(prompt), 0) AS BIGINT) AS prompt_tokens,
         CAST(coalesce(sum(completion), 0) AS BIGINT) AS completion_tokens,
         {p1("count(*) FILTER (WHERE claimed)", "count(*)")} AS claimed_ex
  FROM scored GROUP BY run),
summary AS (
  SELECT *, round(coalesce(avg_gen_ms, 0.0) + coalesce(avg_exec_ms, 0.0), 1) AS avg_total_ms,
         CAST(round(CAST(prompt_tokens AS DECIMAL(20, 0)) * {_VIN} * 0.000001
                    + CAST(completion_tokens AS DECIMAL(20, 0)) * {_VOUT} * 0.000001, 4) AS DOUBLE) AS est_cost_usd
  FROM agg)"""

ISSUES_SQL = f""",
official AS (SELECT n_nationkey AS question FROM nation WHERE n_nationkey < {QUESTIONS}),
issues AS (
  SELECT r.run, 'missing_ids' AS issue FROM (SELECT DISTINCT run FROM runs) r, official q
    WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.run IS NOT DISTINCT FROM r.run AND x.question = q.question) GROUP BY r.run
  UNION ALL SELECT run, 'unknown_ids' FROM runs
    WHERE question IS NOT NULL AND question NOT IN (SELECT question FROM official) GROUP BY run
  UNION ALL SELECT run, 'other_model' FROM summary WHERE model <> '{BOARD_MODEL}'
  UNION ALL SELECT run, 'inflated_claim' FROM summary WHERE claimed_ex - ex_at_1 > 2.0
  UNION ALL SELECT run, 'zero_tokens' FROM summary WHERE total_tokens IS NOT NULL AND prompt_tokens = 0)"""


def submitted_rows(t: Tables):
    """Run rows as they are verified: Set-Recall from the submitted table set (the gold set
    must be inside it) or else the reported flag, tokens from prompt and completion."""
    covered = F.when(F.col("pred_tables").isNotNull(), F.size(F.array_except("gold_tables", "pred_tables")) == 0) \
        .otherwise(F.col("reported"))
    used = F.when(F.col("prompt").isNotNull() | F.col("completion").isNotNull(),
                  F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0)))
    return run_rows(t).withColumn("set_recall", covered).withColumn("tokens", used)


def per_question(t: Tables):
    """What every verified number is made of, per (run, model, question): the one pass over
    the events, written. A run's model takes part in the key (it hardly ever differs
    within a run), since a string minimum would be a sort aggregate over all events."""
    return materialise(sc.partial_sums(submitted_rows(t), "run", "model", "question"))


def verified(parts):
    """Verified numbers of each run from ``per_question``: total latency is the sum of the two
    means, the cost comes from prompt and completion tokens at the model's price."""
    per = sc.add_up(parts, "run", "model")
    sums = [F.sum(c).alias(c) for c in per.columns if c not in ("run", "model")]
    one = per.groupBy("run").agg(F.min("model").alias("_m"), *sums).withColumn(
        "model", F.replace("_m", F.lit("openai/"), F.lit("")))
    r = sc.rates(one, "model").drop("avg_total_ms")
    pin, pout = (p.cast("decimal(6,2)") for p in sc.prefix_price_columns(F.col("model")))
    per_token = F.lit(Decimal("0.000001"))
    cost = (F.col("prompt_tokens").cast("decimal(20,0)") * pin * per_token
            + F.col("completion_tokens").cast("decimal(20,0)") * pout * per_token)
    total = F.round(F.coalesce("avg_gen_ms", F.lit(0.0)) + F.coalesce("avg_exec_ms", F.lit(0.0)), 1)
    return r.withColumn("avg_total_ms", total).withColumn("est_cost_usd", F.round(cost, 4).cast("double"))


def answered(t: Tables):
    """Distinct (run, question) pairs; ``right`` if the run answered it correctly."""
    return run_rows(t).groupBy("run", "question").agg(F.coalesce(F.bool_or("ex"), F.lit(False)).alias("right"))


def summary(t: Tables):
    return sc.summarise(run_rows(t)).select(*sc.SUMMARY_COLUMNS)


def coverage_issues(pairs, official, qid: str = "question"):
    """Runs that lack an official question, and runs with a question that is none, from
    distinct (run, question) pairs. Per run, its official questions are counted against
    their number (a scalar subquery), so no (run, missing question) rows are ever made."""
    n = official.agg(F.count_distinct(qid)).scalar()
    known = official.select(qid).filter(F.col(qid).isNotNull()).distinct().withColumn("_official", F.lit(True))
    per = pairs.join(known, qid, "left").groupBy("run").agg(
        F.count("_official").alias("_have"), F.count_if(F.col("_official").isNull() & F.col(qid).isNotNull()).alias("_odd"))
    per = per.withColumn("_missing", F.col("_have") < n)
    flags = F.array(F.when(F.col("_missing"), F.lit("missing_ids")), F.when(F.col("_odd") > 0, F.lit("unknown_ids")))
    return per.select("run", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("issue"))


def issues_from(per, pairs, official):
    """A run that names no model or reports no tokens is accepted; one that names
    another model or reports zero prompt tokens is not."""
    flags = F.array(
        F.when(F.col("model") != BOARD_MODEL, F.lit("other_model")),
        F.when(F.col("claimed_ex") - F.col("ex_at_1") > sc.CLAIM_SLACK, F.lit("inflated_claim")),
        F.when(F.col("total_tokens").isNotNull() & (F.col("prompt_tokens") == 0), F.lit("zero_tokens")))
    return (per.select("run", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("issue"))
            .unionByName(coverage_issues(pairs, official)))


def _issues(t: Tables, parts, per):
    pairs = parts.groupBy("run", "question").agg(F.count(F.lit(1)).alias("_n"))
    return issues_from(per, pairs, official_questions(t))


def board(t: Tables):
    """(rank, grade and every verified number) of the accepted runs. The events are read
    once (``per_question``); the verified numbers are one written row per run."""
    parts = per_question(t)
    per = materialise(verified(parts))
    ranked = sc.leaderboard(sc.grade(per), _issues(t, parts, per))
    mine = per.withColumnRenamed("run", "_run")
    return ranked.join(mine, ranked["run"].eqNullSafe(mine["_run"])).drop("_run")


@query("ves", "E-VES", "WITH " + SUMMARY_SQL + " SELECT run, ves FROM summary")
def ves(t: Tables):
    return summary(t).select("run", "ves")


_ROLLUP_COLS = ["ex_" + v.replace("-", "_").replace("+", "_plus") for v in sc.SHAPES + sc.RETRIEVALS]


def _rollup_sql():
    cols = []
    for col, values in (("shape", sc.SHAPES), ("retrieval", sc.RETRIEVALS)):
        for v in values:
            name = "ex_" + v.replace("-", "_").replace("+", "_plus")
            cols.append(f"{p1(f'count(*) FILTER (WHERE {col} = $${v}$$ AND ex)', f'count(ex) FILTER (WHERE {col} = $${v}$$)')} AS {name}")
    return ("WITH " + RUNS_SQL + f""" SELECT run, {p1("count(*) FILTER (WHERE ex)", "count(ex)")} AS ex_at_1,
    {r1(f"sum({milli('soft')})", "count(soft) * 10")} AS soft_f1, """
            + ", ".join(cols) + " FROM runs GROUP BY run").replace("$$", "'")


@query("rollup_buckets", "E-ROLLUP", _rollup_sql())
def rollup_buckets(t: Tables):
    return sc.ex_rollup(run_rows(t))


@query("latency_avg", "E-LAT", "WITH " + SUMMARY_SQL +
       " SELECT run, avg_gen_ms, avg_exec_ms, avg_total_ms, avg_gold_ms FROM summary")
def latency_avg(t: Tables):
    return summary(t).select("run", "avg_gen_ms", "avg_exec_ms", "avg_total_ms", "avg_gold_ms")


@query("token_rollup", "E-TOKENS", "WITH " + VERIFIED_SQL + """
SELECT run, prompt_tokens, completion_tokens, total_tokens, avg_tokens, token_coverage, est_cost_usd FROM summary""")
def token_rollup(t: Tables):
    """Prompt and completion tokens, totals, means, coverage and cost of each run."""
    return verified(per_question(t)).select("run", "prompt_tokens", "completion_tokens", "total_tokens", "avg_tokens",
                                            "token_coverage", "est_cost_usd")


COST_PREFIXES = [("P", 1.0, 2.0), ("PRO", 3.0, 6.0), ("S", 0.5, 1.5), ("ST", 0.8, 2.4), ("SM", 0.2, 0.6),
                 ("E", 0.1, 0.3)]


@query("cost_prefix", "E-COST", f"""
WITH prices(prefix, price_in, price_out) AS (VALUES {', '.join(f"('{k}', {a}, {b})" for k, a, b in COST_PREFIXES)}),
hits AS (SELECT p.p_partkey, pr.prefix, pr.price_in, pr.price_out,
                row_number() OVER (PARTITION BY p.p_partkey ORDER BY length(pr.prefix) DESC) AS rn
         FROM part p JOIN prices pr ON starts_with(p.p_type, pr.prefix))
SELECT p.p_partkey, h.prefix,
       round(CAST(p.p_size AS DOUBLE) * 1000 / 1e6 * coalesce(CAST(h.price_in AS DOUBLE), {sc.DEFAULT_PRICE[0]})
             + CAST(p.p_size AS DOUBLE) * 500 / 1e6 * coalesce(CAST(h.price_out AS DOUBLE), {sc.DEFAULT_PRICE[1]}), 6) AS cost
FROM part p LEFT JOIN hits h ON h.p_partkey = p.p_partkey AND h.rn = 1""")
def cost_prefix(t: Tables):
    """Price every part by the longest matching prefix of its type among a
    fixed key list (p_size thousand prompt + half as many completion tokens)."""
    prices = t.spark.createDataFrame(COST_PREFIXES, "prefix string, price_in double, price_out double")
    priced = sc.longest_prefix_price(t.part.select("p_partkey", "p_type", "p_size"), F.col("p_type"),
                                     F.broadcast(prices))
    size = F.col("p_size").cast("double")
    return priced.select("p_partkey", "prefix", F.round(
        size * 1000 / 1e6 * F.coalesce("price_in", F.lit(sc.DEFAULT_PRICE[0]))
        + size * 500 / 1e6 * F.coalesce("price_out", F.lit(sc.DEFAULT_PRICE[1])), 6).alias("cost"))


@query("grade", "E-GRADE", "WITH " + GRADE_SQL + " SELECT * FROM graded")
def grade(t: Tables):
    """The grade needs whole-field minima over the run summaries (a scalar
    subquery) and the summaries themselves: the summaries are written once
    (one row per run), so the events are aggregated once, not twice."""
    return sc.grade(materialise(summary(t)))


@query("validate_runs", "E-VALID", "WITH " + VERIFIED_SQL + ISSUES_SQL + " SELECT run, issue FROM issues")
def validate_runs(t: Tables):
    """Runs that miss or invent questions, use another model, claim too much, or report zero tokens."""
    parts = per_question(t)
    return _issues(t, parts, materialise(verified(parts)))


BOARD_SQL = "WITH " + VERIFIED_SQL + _GRADED_SQL + ISSUES_SQL + """,
board AS (SELECT CAST(row_number() OVER (ORDER BY grade DESC NULLS LAST, run) AS BIGINT) AS rank, run, grade
          FROM graded WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.run IS NOT DISTINCT FROM graded.run))"""


@query("leaderboard", "E-BOARD", BOARD_SQL + " SELECT rank, run, grade FROM board")
def leaderboard(t: Tables):
    """Ranks and grades of the accepted runs, from their verified numbers."""
    return board(t).select("rank", "run", "grade")


@query("rescore", "E-RESCORE", f"""
WITH j AS (SELECT l.doc_id, l.quality, d.doc_id IS NOT NULL AS has_pred,
                  CASE WHEN d.doc_id IS NULL THEN NULL ELSE CAST(d.n_chars >= 1000 AS INTEGER) END AS pred
           FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
SELECT count(*) AS n, {p1("count(*) FILTER (WHERE has_pred AND pred = quality)", "count(*)")} AS ex_at_1,
       count(*) FILTER (WHERE NOT has_pred) AS errors
FROM j""")
def rescore(t: Tables):
    """Gold answers (labels.quality) joined to predictions (documents: long
    text -> quality 1); a missing prediction is an error and not correct."""
    pred = t.documents.select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("pred"),
                              F.lit(True).alias("has_pred"))
    j = t.labels.select("doc_id", "quality").join(pred, "doc_id", "left") \
        .withColumn("has_pred", F.coalesce("has_pred", F.lit(False)))
    ok = F.col("has_pred") & (F.col("pred") == F.col("quality"))
    return j.agg(F.count(F.lit(1)).alias("n"),
                 sc.pct1(F.count_if(F.coalesce(ok, F.lit(False))), F.count(F.lit(1))).alias("ex_at_1"),
                 F.count_if(~F.col("has_pred")).alias("errors"))


@query("oracle_gap", "E-GAP", "WITH " + RUNS_SQL + f"""
SELECT run, {p1("count(*) FILTER (WHERE ex)", "count(ex)")} AS own_ex,
       {p1("count(*) FILTER (WHERE NOT error)", "count(*)")} AS oracle_ex,
       round({p1("count(*) FILTER (WHERE NOT error)", "count(*)")} - {p1("count(*) FILTER (WHERE ex)", "count(ex)")}, 1) AS gap
FROM runs GROUP BY run""")
def oracle_gap(t: Tables):
    """Oracle EX (any non-error answer counts) minus the run's own EX."""
    r = run_rows(t).groupBy("run").agg(
        sc.pct1(F.count_if("ex"), F.count("ex")).alias("own_ex"),
        sc.pct1(F.count_if(~F.col("error")), F.count(F.lit(1))).alias("oracle_ex"))
    return r.withColumn("gap", F.round(F.col("oracle_ex") - F.col("own_ex"), 1))


def _passk_sql(k: int) -> str:
    prod = "1.0"
    for i in range(k):
        prod = f"({prod}) * ((n - c - {i}) / (n - {i}))"
    return f"CASE WHEN n >= {k} THEN round(1.0 - {prod}, 6) END"


@query("pass_at_k", "E-PASSK", f"""
WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS c
           FROM events GROUP BY user_id)
SELECT user_id, n, c, {_passk_sql(PASS_K)} AS pass_at_k FROM s""")
def pass_at_k(t: Tables):
    s = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"),
                                        F.count_if(F.col("event_type") == "purchase").alias("c"))
    return s.withColumn("pass_at_k", F.round(sc.pass_at_k(F.col("n"), F.col("c"), PASS_K), 6))


_VERIFIED = ["run", "n", "errors", "ex_at_1", "ves", "soft_f1", "set_recall", "avg_gen_ms", "avg_exec_ms",
             "avg_total_ms", "avg_tokens", "total_tokens", "token_coverage", "prompt_tokens", "completion_tokens",
             "est_cost_usd"]


@query("rescore_runs", "E-RESCORE", "WITH " + VERIFIED_SQL + f" SELECT {', '.join(_VERIFIED)} FROM summary")
def rescore_runs(t: Tables):
    """Verified numbers of each submission, every metric from its rows."""
    return verified(per_question(t)).select(*_VERIFIED)


@query("oracle_gap_runs", "E-GAP", "WITH " + RUNS_SQL + f""",
q AS (SELECT run, question, coalesce(bool_or(ex), false) AS ok FROM runs WHERE run IS NOT NULL AND question IS NOT NULL GROUP BY 1, 2),
j AS (SELECT a.run // 2 AS tool, a.ok AS own, b.ok AS orc FROM q a JOIN q b ON b.run = a.run + 1 AND b.question = a.question
      WHERE a.run % 2 = 0)
SELECT tool, count(*) AS n, {p1("count(*) FILTER (WHERE own)", "count(*)")} AS own_ex,
       {p1("count(*) FILTER (WHERE orc)", "count(*)")} AS oracle_ex,
       round({p1("count(*) FILTER (WHERE orc)", "count(*)")} - {p1("count(*) FILTER (WHERE own)", "count(*)")}, 1) AS gap
FROM j GROUP BY tool""")
def oracle_gap_runs(t: Tables):
    """A tool's own run (even) joined per question to its oracle run (the odd one after)."""
    q = answered(t).filter("run IS NOT NULL AND question IS NOT NULL")
    own = q.filter("run % 2 = 0").select(F.expr("run div 2").alias("tool"), "question", F.col("right").alias("own"))
    oracle = q.filter("run % 2 = 1").select(F.expr("run div 2").alias("tool"), "question", F.col("right").alias("orc"))
    r = own.join(oracle, ["tool", "question"]).groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"), sc.pct1(F.count_if("own"), F.count(F.lit(1))).alias("own_ex"),
        sc.pct1(F.count_if("orc"), F.count(F.lit(1))).alias("oracle_ex"))
    return r.withColumn("gap", F.round(F.col("oracle_ex") - F.col("own_ex"), 1))
