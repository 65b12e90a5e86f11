"""Source/sink jobs and the plug-in surface (§2.10).

Every writer targets a fresh folder under the session's checkpoint folder
(``spark.checkpoint.dir``), i.e. shared storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.registry import query
from quarry.plans.scoring import RUNS_SQL, SUMMARY_SQL, run_rows
from quarry.plans import scoring as scp
from quarry.session import materialise, scratch_dir
from quarry.sources import files
from quarry.sources.tables import Tables

RESULT_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("ex", T.BooleanType()), T.StructField("error", T.BooleanType()),
    T.StructField("exec_ms", T.DoubleType()), T.StructField("tokens", T.LongType()), T.StructField("run", T.LongType()),
])


def _meta(t: Tables):
    return (t.events.select(F.col("user_id").alias("run")).distinct()
            .select("run", F.concat(F.lit("tool-"), F.col("run").cast("string")).alias("tool"),
                    F.lit("1.0").alias("version")))


def _write_runs(t: Tables) -> str:
    root = scratch_dir(t.spark, "runs")
    files.write_run_folders(run_rows(t).select("run", "qid", "ex", "error", "exec_ms", "tokens"), _meta(t), root)
    return root


@query("roundtrip_orders", "S-LOAD", "SELECT * FROM orders")
def roundtrip_orders(t: Tables):
    """Load of a whole table: overwrite a Parquet copy, read it back."""
    path = scratch_dir(t.spark, "orders")
    t.orders.write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query("json_results", "S-JSON", "WITH " + RUNS_SQL + """
SELECT run, qid, ex, error, exec_ms, tokens, 'tool-' || CAST(run AS VARCHAR) AS tool, '1.0' AS version FROM runs""")
def json_results(t: Tables):
    """Write per-run result files, read them back merged with their meta."""
    root = _write_runs(t)
    return files.read_run_folders(t.spark, root, RESULT_SCHEMA).select(
        "run", "qid", "ex", "error", "exec_ms", "tokens", "tool", "version")


DOCUMENT_SCHEMA = "run long, summary struct<tool string, version string>, results array<struct<qid long, ex boolean, exec_ms double, tokens long>>"


@query("json_documents", "S-JSON", "WITH " + RUNS_SQL + """
SELECT run, count(*) AS n, count(*) FILTER (WHERE ex) AS n_right, CAST(sum(tokens) AS BIGINT) AS tokens,
       'tool-' || CAST(run AS VARCHAR) AS tool FROM runs GROUP BY run""")
def json_documents(t: Tables):
    """Runs written as {summary, results[]} documents, read back and totalled per run."""
    path = scratch_dir(t.spark, "documents")
    files.write_run_documents(run_rows(t).select("run", "qid", "ex", "exec_ms", "tokens"), _meta(t), path)
    rows = files.read_run_documents(t.spark, path, DOCUMENT_SCHEMA, multi_line=False)
    return rows.groupBy("run", F.col("summary.tool").alias("tool")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ex").alias("n_right"), F.sum("tokens").alias("tokens")) \
        .select("run", "n", "n_right", "tokens", "tool")


@query("multi_file_scan", "S-MULTI", f"""
SELECT 'bucket=' || CAST(coalesce(user_id % {files.RUN_BUCKETS}, 0) AS VARCHAR) AS folder, count(*) AS n_results
FROM events GROUP BY 1""")
def multi_file_scan(t: Tables):
    """Scan every run folder; tag rows with the folder they were read from."""
    root = _write_runs(t)
    return (files.read_run_folders(t.spark, root, RESULT_SCHEMA)
            .groupBy(F.col("_folder").alias("folder")).agg(F.count(F.lit(1)).alias("n_results")))


LEDGER_SCHEMA = T.StructType([T.StructField("run", T.LongType()), T.StructField("n", T.LongType()),
                              T.StructField("total_tokens", T.LongType())])


@query("append_ledger", "S-APPEND", "WITH " + SUMMARY_SQL + " SELECT run, n, total_tokens FROM summary")
def append_ledger(t: Tables):
    """A cumulative ledger appended in two batches (even runs, then odd runs)."""
    path = scratch_dir(t.spark, "ledger")
    s = materialise(scp.summary(t).select("run", "n", "total_tokens"))     # aggregated once for both batches
    even = F.coalesce(F.col("run") % 2 == 0, F.lit(False))     # every row lands in exactly one batch
    files.append_ledger(s.filter(even), path)
    files.append_ledger(s.filter(~even), path)
    return files.read_ledger(t.spark, path, LEDGER_SCHEMA)


def _export_sql() -> str:
    """The board as the CSV reads back: every field as text."""
    given = {"rank": "rank", "tool": "'tool-' || CAST(board.run AS VARCHAR)", "grade": "board.grade",
             "est_cost_usd": "CAST(est_cost_usd AS DECIMAL(20, 4))",
             "version": "'1.' || CAST(board.run % 3 AS VARCHAR)"}
    cols = ", ".join(f"CAST({given.get(f, f)} AS VARCHAR) AS {f}" for f in files.EXPORT_FIELDS)
    return f"{scp.BOARD_SQL} SELECT {cols} FROM board JOIN summary ON summary.run IS NOT DISTINCT FROM board.run"


@query("export_csv", "S-EXPORT", _export_sql())
def export_csv(t: Tables):
    """The board with its verified numbers written as JSON and CSV in the fixed field
    order, and the CSV read back. Tool and version stand in for a run's own description."""
    run = F.col("run").cast("string")
    rows = (scp.board(t).withColumn("tool", F.concat(F.lit("tool-"), run))
            .withColumn("version", F.concat(F.lit("1."), (F.col("run") % 3).cast("string")))
            .withColumn("est_cost_usd", F.col("est_cost_usd").cast("decimal(20,4)")))
    path = scratch_dir(t.spark, "export")
    files.export(materialise(rows), path)
    return t.spark.read.schema(", ".join(f"{f} string" for f in files.EXPORT_FIELDS)).option("header", True).csv(f"{path}/csv")


# ---------------------------------------------------------------- X-* ----

PREDICTED = pa.schema([("answer", pa.int32()), ("error", pa.string()), ("prompt_tokens", pa.int32()),
                       ("completion_tokens", pa.int32())])
Predictor = Callable[[pd.DataFrame], pd.DataFrame]


def run_predictor(questions: DataFrame, predict: Predictor, qid: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """X-PREDICT: apply a plug-in to every question, batch by batch (Arrow),
    on the executors: (qid, ``carry`` columns, answer, error, prompt_tokens,
    completion_tokens). Ids of any type, NULL ones too, and carried columns stay in
    Arrow and never pass through the plug-in's answer. A batch that raises, or whose
    answer does not fit, is halved and retried, so only the failing questions get
    ``error`` set; nothing stops the job."""
    kept = [qid, *carry]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting = [batch]
            while waiting:          # a failing batch is halved until the failing questions are alone
                part = waiting.pop()
                try:
                    answers = _answers(predict(part.to_pandas()), part.num_rows)
                except Exception as e:  # noqa: BLE001 -- plug-in errors become data
                    if part.num_rows > 1:
                        half = part.num_rows // 2
                        waiting += [part.slice(half), part.slice(0, half)]
                        continue
                    answers = _answers(pd.DataFrame({"error": [f"{type(e).__name__}: {e}"]}), 1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *answers], names=["qid", *carry, *PREDICTED.names])

    fields = [T.StructField("qid", questions.schema[qid].dataType), *(questions.schema[c] for c in carry)]
    answer = [T.StructField("answer", T.IntegerType()), T.StructField("error", T.StringType()),
              T.StructField("prompt_tokens", T.IntegerType()), T.StructField("completion_tokens", T.IntegerType())]
    return questions.mapInArrow(fn, T.StructType(fields + answer))


def _answers(out: pd.DataFrame, n: int) -> list[pa.Array]:
    """The plug-in's columns in the declared types; a column it lacks is NULL."""
    if len(out) != n:
        raise ValueError(f"{len(out)} answers to {n} questions")
    return [pa.Array.from_pandas(out[f.name]).cast(f.type) if f.name in out else pa.nulls(n, f.type) for f in PREDICTED]


def gold_predictor(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rule-based gold plug-in: answers with the gold value."""
    return pd.DataFrame({"answer": pdf["quality"].to_numpy()})


def picky_predictor(pdf: pd.DataFrame) -> pd.DataFrame:
    """A plug-in that fails on toxic questions (exercises per-row errors)."""
    if (pdf["toxic"] == 1).any():
        raise ValueError("refused")
    return pd.DataFrame({"answer": pdf["quality"].to_numpy(), "prompt_tokens": [10] * len(pdf)})


@query("predict_gold", "X-PREDICT", """
SELECT 'gold' AS plugin, count(*) AS n, CAST(1.0 AS DOUBLE) AS accuracy, CAST(0 AS BIGINT) AS errors FROM labels
UNION ALL
SELECT 'picky', count(*), round(CAST(count(*) FILTER (WHERE toxic IS DISTINCT FROM 1) AS DOUBLE) / count(*), 6),
       count(*) FILTER (WHERE toxic = 1) FROM labels""")
def predict_gold(t: Tables):
    """Plug-ins scored against labels: the gold plug-in must reach 1.0."""
    q = t.labels.select(F.col("doc_id").alias("qid"), "quality", "toxic")
    out = []
    for name, fn in (("gold", gold_predictor), ("picky", picky_predictor)):
        p = run_predictor(q, fn, "qid", ("quality",))
        out.append(p.agg(F.lit(name).alias("plugin"), F.count(F.lit(1)).alias("n"),
                         F.round(F.count_if(F.col("error").isNull() & F.col("answer").eqNullSafe(F.col("quality")))
                                 / F.count(F.lit(1)), 6).alias("accuracy"),
                         F.count_if(F.col("error").isNotNull()).alias("errors")))
    return out[0].unionByName(out[1])


def _recipe_orders(df: DataFrame) -> DataFrame:
    from quarry.plans.synth import PAYMENT_MIX, SEED
    from quarry.operators.synth import uniform
    u = uniform("pay", SEED, F.col("o_orderkey"))
    st = F.lit("captured")
    for name, hi in reversed(PAYMENT_MIX):
        st = F.when(u < hi, F.lit(name)).otherwise(st)
    return df.withColumn("status", st)


def _recipe_customer(df: DataFrame) -> DataFrame:
    from quarry.plans.synth import PLAN_CODES
    return df.withColumn("status", F.element_at(F.array(*[F.lit(c) for c in PLAN_CODES]),
                                                (F.col("c_custkey") % len(PLAN_CODES) + 1).cast("int")))


RECIPES: dict[str, Callable[[DataFrame], DataFrame]] = {"orders": _recipe_orders, "customer": _recipe_customer}


def apply_recipe(table: str, df: DataFrame) -> DataFrame:
    """X-RECIPE: generic columns first, then the table's recipe if registered."""
    return df.transform(RECIPES.get(table, lambda d: d))


def _recipe_sql() -> str:
    from quarry.plans.synth import PAYMENT_MIX, PLAN_CODES, U
    pay = " ".join(f"WHEN u < {hi} THEN '{name}'" for name, hi in PAYMENT_MIX)
    plans = "[" + ", ".join(f"'{c}'" for c in PLAN_CODES) + "]"
    return f"""
SELECT status, n, table_name FROM (
  SELECT CASE {pay} ELSE 'captured' END AS status, count(*) AS n, 'orders' AS table_name
  FROM (SELECT {U('pay', 'o_orderkey')} AS u FROM orders) GROUP BY 1
  UNION ALL
  SELECT ({plans})[c_custkey % {len(PLAN_CODES)} + 1], count(*), 'customer' FROM customer GROUP BY 1
  UNION ALL
  SELECT 'generic', count(*), 'supplier' FROM supplier GROUP BY 1)"""


@query("recipe_transform", "X-RECIPE", _recipe_sql())
def recipe_transform(t: Tables):
    parts = []
    for table, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")):
        generic = t.read(table).select(key).withColumn("status", F.lit("generic"))
        parts.append(apply_recipe(table, generic).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
                     .withColumn("table_name", F.lit(table)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
