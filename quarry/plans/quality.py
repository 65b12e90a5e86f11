"""Data-quality jobs: ``check(tables) -> (rule, violations)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import quality as dq
from quarry.operators.intervals import overlapping_rows
from quarry.plans.registry import query
from quarry.sources.tables import TABLE_NAMES, Tables

ORDER_STATUSES = ["F", "O"]          # declared domain (P is a real violation in the data)
DECLARED_EVENT_TYPES = ["click", "view"]


LINE_ORDER = dq.Link("lineitem", "l_orderkey", "orders", "o_orderkey", ("o_orderdate",))
LINE_SUPPLIER = dq.Link("lineitem", "l_suppkey", "supplier", "s_suppkey", ("s_nationkey",))
ORDER_CUSTOMER = dq.Link("orders", "o_custkey", "customer", "c_custkey", ("c_nationkey",))


def _overlap(read) -> DataFrame:
    li = read("lineitem").select("l_partkey", "l_orderkey", "l_shipdate", F.timestamp_add(
        "DAY", F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("l_end"))
    return overlapping_rows(li, ["l_partkey"], "l_shipdate", "l_end", "l_orderkey")


RULES = [
    dq.RowRule("isolation:lineitem_supplier_nation", "lineitem", lambda: F.col("s_nationkey") != F.col("c_nationkey"),
               (LINE_ORDER, ORDER_CUSTOMER, LINE_SUPPLIER)),
    dq.RowRule("temporal:ship_before_order", "lineitem", lambda: F.col("l_shipdate") < F.col("o_orderdate"), (LINE_ORDER,)),
    dq.RowRule("nonneg:customer_acctbal", "customer", lambda: F.col("c_acctbal") < 0),
    dq.RowRule("nonneg:lineitem_quantity", "lineitem", lambda: dq.check_fails(F.col("l_quantity") > 0)),
    dq.orphan(ORDER_CUSTOMER),
    dq.orphan(LINE_ORDER),
    dq.Rule("unique:lineitem_order_line", lambda read: dq.duplicate_keys(read("lineitem"), ["l_orderkey", "l_linenumber"])),
    dq.RowRule("check:discount_0_1", "lineitem", lambda: dq.check_fails(F.col("l_discount").between(0, 1))),
    dq.RowRule("domain:order_status", "orders",
               lambda: F.col("o_orderstatus").isNotNull() & ~F.col("o_orderstatus").isin(*ORDER_STATUSES)),
    dq.Rule("overlap:part_ship_window", _overlap),
]

_RULES_SQL = [
    ("isolation:lineitem_supplier_nation", """SELECT count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
       JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
       WHERE s.s_nationkey <> c.c_nationkey"""),
    ("temporal:ship_before_order", """SELECT count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
       WHERE l.l_shipdate < o.o_orderdate"""),
    ("nonneg:customer_acctbal", "SELECT count(*) FROM customer WHERE c_acctbal < 0"),
    ("nonneg:lineitem_quantity", "SELECT count(*) FROM lineitem WHERE NOT coalesce(l_quantity > 0, true)"),
    ("orphan:orders_customer", """SELECT count(*) FROM orders o WHERE o.o_custkey IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)"""),
    ("orphan:lineitem_orders", """SELECT count(*) FROM lineitem l WHERE l.l_orderkey IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)"""),
    ("unique:lineitem_order_line", """SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem
       GROUP BY 1, 2 HAVING count(*) > 1)"""),
    ("check:discount_0_1", "SELECT count(*) FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 1, true)"),
    ("domain:order_status", "SELECT count(*) FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')"),
    ("overlap:part_ship_window", """SELECT count(*) FROM (
       SELECT l_shipdate AS s,
              max(coalesce(l_shipdate + to_days(CAST(l_quantity AS INTEGER)), TIMESTAMP '9999-12-31 00:00:00')) OVER (
         PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
       FROM lineitem WHERE l_shipdate IS NOT NULL AND l_partkey IS NOT NULL) WHERE s < pm"""),
]
_SQL = dict(_RULES_SQL)


def _one(name: str) -> str:
    return f"SELECT '{name}' AS rule, CAST(({_SQL[name]}) AS BIGINT) AS violations"


def _rule(name: str):
    return next(r for r in RULES if r.name == name)


def _single(qname: str, op: str, *rule_names: str):
    @query(qname, op, " UNION ALL ".join(_one(n) for n in rule_names))
    def _q(t: Tables):
        return dq.counts([_rule(n) for n in rule_names], t.read)
    _q.__name__ = qname
    return _q


_single("dq_isolation", "D-ISOLATION", "isolation:lineitem_supplier_nation")
_single("dq_temporal", "D-TEMPORAL", "temporal:ship_before_order")
_single("dq_negative", "D-NONNEG", "nonneg:customer_acctbal", "nonneg:lineitem_quantity")
_single("dq_orphans", "D-ORPHAN", "orphan:orders_customer", "orphan:lineitem_orders")
_single("dq_unique", "D-UNIQUE", "unique:lineitem_order_line")
_single("dq_check", "D-CHECK", "check:discount_0_1")
_single("dq_domain", "D-DOMAIN", "domain:order_status")
_single("dq_overlap", "D-OVERLAP", "overlap:part_ship_window")


@query("dq_partial_unique", "D-PARTUNIQUE", """
SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY conv_id HAVING count(*) > 1""")
def dq_partial_unique(t: Tables):
    """At most one flagged row (system turn) per parent (conversation)."""
    return dq.duplicate_keys(t.conversations.filter(F.col("role") == "system"), ["conv_id"])


@query("dq_nulls", "D-NOTNULL", " UNION ALL ".join(
    f"SELECT 'notnull:{c}' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM orders"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def dq_nulls(t: Tables):
    return dq.null_counts(t.orders)


@query("dq_report", "D-REVALIDATE", " UNION ALL ".join(
    f"SELECT * FROM ({_one(n)}) WHERE violations > 0" for n, _ in _RULES_SQL))
def dq_report(t: Tables):
    """All rules in six table scans: lines with their orders, customers and suppliers in one
    tagged left join, and two rules over lines alone."""
    return dq.report(RULES, t.read)


_MIX = [("orders", "o_orderstatus"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"),
        ("conversations", "role")]


@query("dq_status_mix", "D-MIX", " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM {tb} GROUP BY {c}" for tb, c in _MIX))
def dq_status_mix(t: Tables):
    parts = [t.read(tb).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(c).alias("col"), "value", "n") for tb, c in _MIX]
    return reduce(DataFrame.unionByName, parts).orderBy("col", F.desc("n"), "value")


@query("dq_row_counts", "D-COUNTS", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, count(*) AS n FROM {tb}" for tb in TABLE_NAMES))
def dq_row_counts(t: Tables):
    return row_counts(t)


def row_counts(t: Tables) -> DataFrame:
    # count(*) on Parquet reads footers/row-group metadata only.
    return reduce(DataFrame.unionByName, [t.read(tb).agg(F.count(F.lit(1)).alias("n"))
                                          .select(F.lit(tb).alias("table_name"), "n") for tb in TABLE_NAMES])


_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _empty_sql(rel: str, cols: list[str]) -> str:
    """No rows, or exactly one row whose cells are all NULL."""
    all_null = " AND ".join(f"{c} IS NULL" for c in cols)
    n = f"(SELECT count(*) FROM ({rel}) q)"
    return f"({n} = 0 OR ({n} = 1 AND (SELECT count(*) FROM ({rel}) q WHERE NOT ({all_null})) = 0))"


_EMPTY_CASES_SQL = [
    ("orders_without_lines", "SELECT * FROM orders o WHERE NOT EXISTS "
                             "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)", _ORDERS_COLS),
    ("orders_status_x", "SELECT * FROM orders WHERE o_orderstatus = 'X'", _ORDERS_COLS),
    ("max_of_nothing", "SELECT max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'X'", ["m"]),
    ("customers", "SELECT c_custkey FROM customer", ["c_custkey"]),
]


@query("audit_empty", "D-EMPTY", " UNION ALL ".join(
    f"SELECT '{name}' AS result, {_empty_sql(rel, cols)} AS is_empty" for name, rel, cols in _EMPTY_CASES_SQL))
def audit_empty(t: Tables):
    """Empty-result audit: a result is empty if it has no rows or a single row of
    NULLs. Lazy: at most two rows of each derived result are looked at."""
    cases = {
        "orders_without_lines": t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")),
                                              "o_orderkey", "left_anti"),
        "orders_status_x": t.orders.filter(F.col("o_orderstatus") == "X"),
        "max_of_nothing": t.orders.filter(F.col("o_orderstatus") == "X").agg(F.max("o_totalprice").alias("m")),
        "customers": t.customer.select("c_custkey"),
    }
    def verdict(name: str, df: DataFrame) -> DataFrame:
        blank = reduce(lambda x, y: x & y, [F.col(f"`{c}`").isNull() for c in df.columns])
        probe = df.limit(2).agg(F.count(F.lit(1)).alias("n"), F.count_if(~blank).alias("filled"))
        return probe.select(F.lit(name).alias("result"),
                            ((F.col("n") == 0) | ((F.col("n") == 1) & (F.col("filled") == 0))).alias("is_empty"))

    return reduce(DataFrame.unionByName, [verdict(name, df) for name, df in cases.items()])


@query("audit_declared", "D-DECLARED", f"""
WITH used AS (SELECT DISTINCT user_id, event_type FROM events),
     users AS (SELECT DISTINCT user_id FROM events),
     declared AS (SELECT user_id, unnest({['click', 'view']}) AS event_type FROM users)
SELECT d.user_id, d.event_type, 'missing' AS issue FROM declared d
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.user_id = d.user_id AND u.event_type = d.event_type)
UNION ALL
SELECT user_id, event_type, 'spurious' FROM used WHERE event_type NOT IN ('click', 'view')""")
def audit_declared(t: Tables):
    """Declared set must equal the used set: report missing and spurious members per owner."""
    used = t.events.select("user_id", "event_type").distinct()
    declared = (t.events.select("user_id").distinct()
                .select("user_id", F.explode(F.array(*[F.lit(v) for v in DECLARED_EVENT_TYPES])).alias("event_type")))
    missing = declared.join(used, ["user_id", "event_type"], "left_anti").withColumn("issue", F.lit("missing"))
    spurious = used.filter(~F.col("event_type").isin(*DECLARED_EVENT_TYPES)).withColumn("issue", F.lit("spurious"))
    return missing.unionByName(spurious)


@query("dup_documents", "D-DUP", """
SELECT min(doc_id) AS first_doc_id, count(*) AS n_docs FROM documents
GROUP BY lower(trim(text)) HAVING count(*) > 1""")
def dup_documents(t: Tables):
    """Duplicate texts after lower/trim. Grouped by a SHA-256 of the
    normalised text so the shuffle carries 32 bytes per document, not the
    text (up to 20k words); min(doc_id) and count are partial aggregates."""
    key = F.sha2(F.lower(F.trim("text")), 256)
    return (t.documents.groupBy(key.alias("h")).agg(F.min("doc_id").alias("first_doc_id"),
                                                     F.count(F.lit(1)).alias("n_docs"))
            .filter("n_docs > 1").drop("h"))
