"""File sources and sinks for run results, ledgers and exports.

Layouts:

* run folders: ``<root>/results/bucket=<n>/`` JSON lines, one row per question with its
  run, and the same under ``<root>/meta`` (tool, version, ...). The number of
  folders is fixed (``RUN_BUCKETS``), whatever the number of runs.
* run documents: ``{"run": ..., "summary": {...}, "results": [...]}``, one JSON
  document per line, or one per file (multiLine).
* ledger: tab-separated, header per file, appended batch by batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed field order of the exported leaderboard; fields a run lacks are NULL.
EXPORT_FIELDS = ["rank", "tool", "grade", "ex_at_1", "ves", "soft_f1", "set_recall", "avg_total_ms", "avg_tokens",
                 "est_cost_usd", "errors", "model", "version"]


RUN_BUCKETS = 64


def run_bucket(run: Column) -> Column:
    """The folder a run's rows are in; a NULL run is in bucket 0."""
    return F.coalesce(F.pmod(run, F.lit(RUN_BUCKETS)), F.lit(0)).cast("int")


def write_run_folders(results: DataFrame, meta: DataFrame, root: str, run_col: str = "run") -> None:
    """Results in a fixed number of folders by run, written in parallel; meta rows likewise."""
    # REBALANCE: a folder is written by few tasks (few files), and AQE splits
    # one that holds a large share of the rows.
    for df, name in ((results, "results"), (meta, "meta")):
        (df.withColumn("bucket", run_bucket(F.col(run_col))).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").json(f"{root}/{name}"))


def read_run_folders(spark: SparkSession, root: str, schema: T.StructType | None = None,
                     run_col: str = "run") -> DataFrame:
    """All run folders that hold results, tagged with the folder they came
    from, joined to their meta (left: meta is optional)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    res = reader.json(f"{root}/results").withColumn("_folder", F.regexp_extract(
        F.col("_metadata.file_path"), r"/([^/]+=[^/]+)/[^/]*$", 1))
    meta = spark.read.json(f"{root}/meta").drop("bucket")
    if run_col not in meta.columns:            # every run is NULL
        meta = meta.withColumn(run_col, F.lit(None).cast(res.schema[run_col].dataType))
    meta = meta.withColumnRenamed(run_col, "_mrun")
    return res.drop("bucket").join(meta, res[run_col].eqNullSafe(meta["_mrun"]), "left").drop("_mrun")


def write_run_documents(results: DataFrame, meta: DataFrame, path: str, run_col: str = "run") -> None:
    """One document per run and part of at most ``PART_ROWS`` questions, so a document stays bounded."""
    cols = [c for c in results.columns if c != run_col]
    sizes = results.groupBy(run_col).agg(F.count(F.lit(1)).alias("_n"))
    parts = (results.join(sizes, results[run_col].eqNullSafe(sizes[run_col])).drop(sizes[run_col])
             .withColumn("part", F.pmod(F.xxhash64("qid"), F.ceil(F.col("_n") / PART_ROWS)))
             .groupBy(run_col, "part").agg(F.collect_list(F.struct(*cols)).alias("results")))
    m = meta.select(F.col(run_col).alias("_mrun"), F.struct(*[c for c in meta.columns if c != run_col]).alias("summary"))
    (parts.join(m, parts[run_col].eqNullSafe(m["_mrun"]), "left").select(run_col, "summary", "results")
     .write.mode("overwrite").json(path))


PART_ROWS = 10_000


def read_run_documents(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None,
                       multi_line: bool = True) -> DataFrame:
    """``{summary, results[]}`` documents -> one row per result, with the
    document's summary, its run if it names one, and its file path."""
    reader = spark.read.option("multiLine", multi_line)
    doc = (reader.schema(schema) if schema is not None else reader).json(paths)
    own = [c for c in doc.columns if c not in ("summary", "results")]
    return doc.select(F.col("_metadata.file_path").alias("source_file"), *own, "summary",
                      F.explode_outer("results").alias("r")).select("source_file", *own, "summary", "r.*")


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("sep", "\t").csv(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def export(df: DataFrame, path: str, fields: list[str] = EXPORT_FIELDS) -> DataFrame:
    """Write ``fields`` in order (missing ones NULL, extra ones dropped) as
    JSON and CSV; returns the projected frame."""
    have = set(df.columns)
    out = df.select(*[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields])
    out.write.mode("overwrite").json(f"{path}/json")
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return out
