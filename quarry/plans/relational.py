"""Relational query shapes over the fixture tables.

Conventions that keep Spark and the DuckDB oracle byte-identical:
counts are BIGINT, money totals are rounded to cents (summation order only
moves the 1e-9 digits), averages to 6 places, ranks and hours are cast to
BIGINT, months are TIMESTAMP_NTZ. Fixed-size dimensions (region, nation) are
broadcast by hint; everything else is left to AQE's measured-size choice.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import MAX_LETTERS, pad_key, base26, epoch_micros, iso_date, iso_ts, money, month_ntz, slug
from quarry.operators.intervals import count_overlapping_pairs
from quarry.operators.windows import running_sum
from quarry.plans.registry import query
from quarry.sources.tables import Tables

DAY_US = 86_400_000_000


# ---------------------------------------------------------------- scans ----

@query("scan_supplier", "S-SCAN", "SELECT * FROM supplier")
def scan_supplier(t: Tables):
    """A whole-table scan (supplier grows with the scale factor)."""
    return t.supplier


@query("schema_text", "S-CONCAT", """
SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types
FROM part GROUP BY p_brand""")
def schema_text(t: Tables):
    # Distinct values per owner are de-duplicated map-side by the two-level
    # aggregate (brand, type) before the ordered concat; the concat input per
    # owner is bounded by the type vocabulary, not by the row count.
    pairs = t.part.select("p_brand", "p_type").distinct()
    return (pairs.groupBy("p_brand")
            .agg(F.array_join(F.array_sort(F.collect_list("p_type")), ", ").alias("types")))


# ------------------------------------------------------ projections/filters

@query("project_orders", "P-PROJ", "SELECT o_orderkey, o_totalprice AS total FROM orders")
def project_orders(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("total"))


@query("filter_eq", "P-EQ", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t: Tables):
    return t.orders.filter(F.col("o_orderstatus") == "F").agg(F.count(F.lit(1)).alias("n"))


@query("filter_bool", "P-BOOL", "SELECT count(*) AS n FROM labels WHERE (toxic = 1) = true")
def filter_bool(t: Tables):
    return t.labels.filter((F.col("toxic") == 1) == F.lit(True)).agg(F.count(F.lit(1)).alias("n"))


@query("filter_gt", "P-CMP",
       "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000")
def filter_gt(t: Tables):
    return t.customer.filter(F.col("c_acctbal") > 5000).select("c_custkey", "c_name", "c_acctbal")


@query("filter_time", "P-RANGE", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= date_trunc('month', DATE '2001-08-15') - INTERVAL 12 MONTH""")
def filter_time(t: Tables):
    # The bound folds to a constant, so it is pushed into the Parquet scan.
    bound = F.add_months(F.trunc(F.lit("2001-08-15").cast("date"), "MM"), -12).cast("timestamp_ntz")
    return t.orders.filter(F.col("o_orderdate") >= bound).select("o_orderkey", "o_orderdate")


@query("filter_notnull", "P-NULL", """
SELECT count(DISTINCT o.o_orderkey) AS n
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE l.l_orderkey IS NOT NULL""")
def filter_notnull(t: Tables):
    # LEFT JOIN ... IS NOT NULL is a semi join; say so, so no row fans out.
    o = t.orders.select("o_orderkey")
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(l, "o_orderkey", "left_semi").agg(F.count_distinct("o_orderkey").alias("n"))


@query("filter_in", "P-IN", """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority""")
def filter_in(t: Tables):
    return (t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))


@query("filter_and", "P-AND", """
SELECT count(*) AS n, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus = 'F' AND c.c_mktsegment = 'BUILDING'""")
def filter_and(t: Tables):
    o = t.orders.filter(F.col("o_orderstatus") == "F").select("o_custkey", "o_totalprice")
    c = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("distinct_ci", "P-CI", """
SELECT DISTINCT lower(CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END) AS role
FROM conversations""")
def distinct_ci(t: Tables):
    # citext semantics: values equal up to case are one value. The key is
    # normalised to lower case, so the DISTINCT is a hash aggregate (a
    # collated string key would make Spark sort every row to group it).
    mixed = F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role"))
    return t.conversations.select(F.lower(mixed).alias("role")).distinct()


# ---------------------------------------------------------------- joins ----

@query("join_inner", "J-INNER", """
SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def join_inner(t: Tables):
    return (t.orders.select("o_orderkey", "o_custkey")
            .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
            .select("o_orderkey", "c_name"))


@query("join_count", "J-INNERCOUNT", """
SELECT count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
WHERE l.l_returnflag = 'R' AND o.o_orderstatus = 'F'""")
def join_count(t: Tables):
    l = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("k"))
    o = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("k"))
    return l.join(o, "k").agg(F.count(F.lit(1)).alias("n"))


JOIN_MULTI_SQL = """
SELECT n.n_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY n.n_name"""


@query("join_multi", "J-MULTI", JOIN_MULTI_SQL)
def join_multi(t: Tables):
    """Revenue per nation. Orders are pre-aggregated per customer before the
    customer join, so the big shuffle carries one row per customer, not per
    order; nation (25 rows) is broadcast."""
    per_cust = (t.orders.groupBy(F.col("o_custkey").alias("c_custkey"))
                .agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("s")))
    return (per_cust.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
            .join(t.dim("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
            .groupBy("n_name")
            .agg(F.sum("k").alias("n_orders"), F.round(F.sum("s"), 2).alias("revenue")))


@query("join_chain", "J-CHAIN4", """
SELECT r.r_name, round(sum(l.l_quantity), 2) AS quantity, count(*) AS n_lines
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
GROUP BY r.r_name""")
def join_chain(t: Tables):
    lines = (t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("k")))
    per_cust = (lines.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
                .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("q").alias("q"), F.sum("k").alias("k")))
    geo = (t.dim("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
           .join(t.dim("region"), "r_regionkey"))
    return (per_cust.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
            .join(F.broadcast(geo), "c_nationkey")
            .groupBy("r_name").agg(F.round(F.sum("q"), 2).alias("quantity"), F.sum("k").alias("n_lines")))


@query("join_fanout", "J-FANOUT", """
SELECT e.event_type, count(*) AS n_pairs, round(avg(o.o_totalprice), 4) AS avg_price
FROM orders o JOIN events e ON o.o_custkey = e.user_id
GROUP BY e.event_type""")
def join_fanout(t: Tables):
    """Many-to-many average with multiplicity, without building the pairs.

    avg over the join = sum_k n_e(k)*S_o(k) / sum_k n_e(k)*N_o(k), where per
    key k: S_o, N_o are the order price sum/count and n_e the event count per
    type. Both sides collapse to one row per key before the join, so a hot
    customer costs one row, not orders x events.
    """
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("no"), F.count("o_totalprice").alias("nv"), F.sum("o_totalprice").alias("so"))
    e = t.events.groupBy(F.col("user_id").alias("k"), "event_type").agg(F.count(F.lit(1)).alias("ne"))
    # avg skips NULL prices: the denominator counts priced orders only.
    return (e.join(o, "k").groupBy("event_type")
            .agg(F.sum(F.col("ne") * F.col("no")).alias("n_pairs"),
                 F.round(F.try_divide(F.sum(F.col("ne") * F.col("so")), F.sum(F.col("ne") * F.col("nv"))), 4)
                 .alias("avg_price")))


@query("join_anti", "J-ANTI", """
SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE l.l_orderkey IS NULL""")
def join_anti(t: Tables):
    return t.orders.select("o_orderkey").join(
        t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("join_not_exists", "J-NOTEXISTS", """
SELECT c.c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def join_not_exists(t: Tables):
    f = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(f, "c_custkey", "left_anti")


@query("join_semi", "J-SEMI", """
SELECT DISTINCT c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'F' AND o.o_totalprice > 300000""")
def join_semi(t: Tables):
    f = (t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
         .select(F.col("o_custkey").alias("c_custkey")))
    return t.customer.select("c_custkey", "c_name").join(f, "c_custkey", "left_semi").select("c_name").distinct()


@query("join_semi_anti", "J-SEMIANTI", """
SELECT DISTINCT c.c_custkey FROM customer c
JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
LEFT JOIN events e ON e.user_id = c.c_custkey
WHERE e.user_id IS NULL""")
def join_semi_anti(t: Tables):
    f = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    ev = t.events.select(F.col("user_id").alias("c_custkey"))
    return (t.customer.select("c_custkey").join(f, "c_custkey", "left_semi")
            .join(ev, "c_custkey", "left_anti").distinct())


@query("join_composite", "J-COMPOSITE", """
SELECT c.c_nationkey, count(*) AS n_pairs
FROM customer c JOIN supplier s
  ON s.s_nationkey = c.c_nationkey AND sign(s.s_acctbal) = sign(c.c_acctbal)
GROUP BY c.c_nationkey""")
def join_composite(t: Tables):
    """Pair count of a many-to-many join on (nation, sign): both sides are
    counted per composite key first, so the join is key-to-key."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("nk"), F.signum("c_acctbal").alias("sg")) \
        .agg(F.count(F.lit(1)).alias("nc"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nk"), F.signum("s_acctbal").alias("sg")) \
        .agg(F.count(F.lit(1)).alias("ns"))
    return (c.join(s, ["nk", "sg"]).groupBy(F.col("nk").alias("c_nationkey"))
            .agg(F.sum(F.col("nc") * F.col("ns")).alias("n_pairs")))


@query("join_left", "J-LEFT", """
SELECT o.o_orderkey, count(l.l_orderkey) AS n_lines
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def join_left(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return (t.orders.select("o_orderkey").join(lines, "o_orderkey", "left")
            .select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines")))


@query("join_theta", "J-THETA", """
SELECT count(*) AS n FROM lineitem l JOIN orders o
  ON o.o_orderkey = l.l_orderkey AND l.l_shipdate < o.o_orderdate""")
def join_theta(t: Tables):
    l = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_shipdate")
    o = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderdate")
    return (l.join(o, (l.k == o.k) & (l.l_shipdate < o.o_orderdate))
            .agg(F.count(F.lit(1)).alias("n")))


@query("join_overlap", "J-OVERLAP", """
SELECT a.o_custkey, count(*) AS n_pairs
FROM orders a JOIN orders b
  ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY
 AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY
GROUP BY a.o_custkey""")
def join_overlap(t: Tables):
    return count_overlapping_pairs(t.orders, "o_custkey", "o_orderdate", "o_orderkey", 30 * DAY_US)


@query("posexplode_embedding", "J-POSEXPLODE", """
SELECT CAST(i - 1 AS INTEGER) AS pos, count(*) AS n, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean_x
FROM embeddings, range(1, 65) r(i)
WHERE i <= len(embedding)
GROUP BY i""")
def posexplode_embedding(t: Tables):
    return (t.embeddings.select(F.posexplode("embedding").alias("pos", "x"))
            .groupBy("pos").agg(F.count(F.lit(1)).alias("n"),
                                F.round(F.avg(F.col("x").cast("double")), 6).alias("mean_x")))


# ---------------------------------------------------------- aggregation ----

@query("count_all", "A-COUNT", "SELECT count(*) AS n FROM customer")
def count_all(t: Tables):
    return t.customer.agg(F.count(F.lit(1)).alias("n"))


@query("sum_filtered", "A-SUM",
       "SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'")
def sum_filtered(t: Tables):
    return t.orders.filter(F.col("o_orderstatus") == "F").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("avg_price", "A-AVG", "SELECT round(avg(o_totalprice), 6) AS avg_total FROM orders")
def avg_price(t: Tables):
    return t.orders.agg(F.round(F.avg("o_totalprice"), 6).alias("avg_total"))


@query("count_distinct", "A-CNTD", """
SELECT count(DISTINCT o.o_custkey) AS n
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE r.r_name = 'EUROPE'""")
def count_distinct(t: Tables):
    eu = (t.dim("region").filter(F.col("r_name") == "EUROPE").select(F.col("r_regionkey").alias("n_regionkey"))
          .join(t.dim("nation"), "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey")))
    cust = t.customer.select("c_custkey", "c_nationkey").join(F.broadcast(eu), "c_nationkey", "left_semi")
    buyers = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    return buyers.join(cust, "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_status", "A-DISTINCT", "SELECT DISTINCT o_orderstatus FROM orders")
def distinct_status(t: Tables):
    return t.orders.select("o_orderstatus").distinct()


@query("group_count", "A-GROUPCOUNT",
       "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_count(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("group_sum", "A-GROUPSUM", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority""")
def group_sum(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("group_join", "A-GROUPJOIN", """
SELECT c.c_mktsegment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment""")
def group_join(t: Tables):
    per_cust = (t.orders.groupBy(F.col("o_custkey").alias("c_custkey"))
                .agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("s")))
    return (per_cust.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
            .groupBy("c_mktsegment").agg(F.sum("k").alias("n_orders"), F.round(F.sum("s"), 2).alias("revenue")))


@query("group_multi", "A-GROUPMULTI", """
SELECT c.c_custkey, c.c_name, count(*) AS n_orders
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_name HAVING count(*) > 3""")
def group_multi(t: Tables):
    per_cust = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return (per_cust.filter("n_orders > 3").join(t.customer.select("c_custkey", "c_name"), "c_custkey")
            .select("c_custkey", "c_name", "n_orders"))


@query("group_month", "A-GROUPEXPR", """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n_orders,
       round(sum(o_totalprice), 2) AS revenue
FROM orders GROUP BY 1""")
def group_month(t: Tables):
    return (t.orders.groupBy(month_ntz("o_orderdate").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")))


@query("having_count", "A-HAVING", """
SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING count(*) >= 4""")
def having_count(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).filter("n_turns >= 4")


@query("ratio_filter", "A-FILTER", """
SELECT round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*), 6) AS share_f
FROM orders""")
def ratio_filter(t: Tables):
    return t.orders.agg(F.round(F.try_divide(F.count_if(F.col("o_orderstatus") == "F").cast("double"),
                                             F.count(F.lit(1))), 6).alias("share_f"))


@query("count_col", "A-COUNTCOL", """
SELECT o.o_orderstatus, count(l.l_returnflag) AS n_flags
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus""")
def count_col(t: Tables):
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_returnflag").alias("c"))
    return (l.join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
            .groupBy("o_orderstatus").agg(F.sum("c").alias("n_flags")))


@query("bag_counts", "A-BAG", """
SELECT l_returnflag, l_linestatus, count(*) AS multiplicity FROM lineitem GROUP BY 1, 2""")
def bag_counts(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("multiplicity"))


# -------------------------------------------------------------- windows ----
# The unpartitioned windows below run over an already-aggregated result whose
# size is fixed by a domain (5 segments, ~80 months), never over raw rows.

@query("rank_segments", "W-RANK", """
SELECT c.c_mktsegment, round(sum(o.o_totalprice), 2) AS revenue,
       rank() OVER (ORDER BY round(sum(o.o_totalprice), 2) DESC NULLS FIRST) AS rnk
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment""")
def rank_segments(t: Tables):
    seg = group_join(t).select("c_mktsegment", "revenue")
    return seg.withColumn("rnk", F.rank().over(Window.orderBy(F.desc_nulls_first("revenue"))).cast("long"))


RUNNING_MONTH_SQL = """
WITH m AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue
  FROM orders GROUP BY 1)
SELECT month, CAST(revenue AS DOUBLE) AS revenue,
       CAST(sum(revenue) OVER (ORDER BY month NULLS LAST) AS DOUBLE) AS running_revenue
FROM m"""


@query("running_month", "W-RUNSUM", RUNNING_MONTH_SQL)
def running_month(t: Tables):
    m = t.orders.groupBy(month_ntz("o_orderdate").alias("month")).agg(F.sum(money("o_totalprice")).alias("r"))
    return m.select("month", F.col("r").cast("double").alias("revenue"),
                    F.sum("r").over(Window.orderBy(F.asc_nulls_last("month"))).cast("double").alias("running_revenue"))


RUNNING_CUSTOMER_SQL = """
SELECT o_custkey, o_orderkey, o_orderdate,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST) AS DOUBLE)
         AS running_total
FROM orders"""


def _running_customer(t: Tables):
    return running_sum(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
                       ["o_custkey"], "o_orderdate", money("o_totalprice"), out="running_total") \
        .select("o_custkey", "o_orderkey", "o_orderdate", F.col("running_total").cast("double").alias("running_total"))


@query("running_customer", "W-RUNSUMPART", RUNNING_CUSTOMER_SQL)
def running_customer(t: Tables):
    """Per-customer running total (RANGE frame) over ranges of (customer, date),
    so one hot customer spreads over as many tasks as its rows fill."""
    return _running_customer(t)


@query("lag_month", "W-LAG", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n_orders
           FROM orders GROUP BY 1)
SELECT month, n_orders, n_orders - lag(n_orders) OVER (ORDER BY month NULLS LAST) AS delta FROM m""")
def lag_month(t: Tables):
    m = t.orders.groupBy(month_ntz("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"))
    return m.withColumn("delta", F.col("n_orders") - F.lag("n_orders").over(Window.orderBy(F.asc_nulls_last("month"))))


# ------------------------------------------------------------ sort/top-k ----

@query("sort_revenue", "T-SORT", JOIN_MULTI_SQL + " ORDER BY revenue DESC")
def sort_revenue(t: Tables):
    return join_multi(t).orderBy(F.desc_nulls_first("revenue"), "n_name")


@query("sort_multi", "T-SORTMULTI", """
SELECT c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey NULLS LAST, c_acctbal DESC NULLS FIRST""")
def sort_multi(t: Tables):
    return t.customer.select("c_nationkey", "c_custkey", "c_acctbal") \
        .orderBy(F.asc_nulls_last("c_nationkey"), F.desc_nulls_first("c_acctbal"))


@query("topk_orders", "T-TOPK", """
SELECT l_orderkey, round(sum(l_extendedprice), 2) AS gross FROM lineitem
GROUP BY l_orderkey ORDER BY gross DESC NULLS FIRST, l_orderkey NULLS LAST LIMIT 10""")
def topk_orders(t: Tables):
    # orderBy+limit plans as TakeOrderedAndProject: per-partition top 10,
    # then a 10 x partitions merge -- no global sort.
    return (t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("gross"))
            .orderBy(F.desc_nulls_first("gross"), F.asc_nulls_last("l_orderkey")).limit(10))


@query("top1_hour", "T-TOP1", """
SELECT CAST(hour(ts) AS BIGINT) AS hr, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC NULLS FIRST, hr NULLS LAST LIMIT 1""")
def top1_hour(t: Tables):
    return (t.events.groupBy(F.hour("ts").cast("long").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc_nulls_first("n"), F.asc_nulls_last("hr")).limit(1))


@query("firstn_running", "T-FIRSTN",
       RUNNING_CUSTOMER_SQL + " ORDER BY o_custkey NULLS LAST, o_orderdate NULLS LAST, o_orderkey NULLS LAST LIMIT 50")
def firstn_running(t: Tables):
    return _running_customer(t).orderBy(F.asc_nulls_last("o_custkey"), F.asc_nulls_last("o_orderdate"),
                                        F.asc_nulls_last("o_orderkey")).limit(50)


# ------------------------------------------------------------- bag/set ops --

# A predicted line status next to the recorded one: open when shipped after
# the status date, else filled. Both bags cover every line.
STATUS_DATE = "1995-06-17 00:00:00"
PREDICTED_STATUS_SQL = f"CASE WHEN l_shipdate > TIMESTAMP '{STATUS_DATE}' THEN 'O' ELSE 'F' END"


def predicted_status() -> Column:
    return F.when(F.col("l_shipdate") > F.expr(f"TIMESTAMP_NTZ'{STATUS_DATE}'"), F.lit("O")).otherwise(F.lit("F"))


@query("bag_intersect", "U-INTERSECTALL", f"""
WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS m FROM lineitem GROUP BY 1, 2),
     b AS (SELECT l_returnflag, {PREDICTED_STATUS_SQL} AS l_linestatus, count(*) AS m FROM lineitem GROUP BY 1, 2)
SELECT a.l_returnflag, a.l_linestatus, least(a.m, b.m) AS common
FROM a JOIN b ON a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag
             AND a.l_linestatus IS NOT DISTINCT FROM b.l_linestatus""")
def bag_intersect(t: Tables):
    """INTERSECT ALL of the recorded and the predicted (flag, status) bags:
    sum of min multiplicities. One scan: every line emits its recorded and
    its predicted key, tagged by side, into one partial-aggregated count."""
    sides = F.explode(F.array(
        F.struct(F.col("l_linestatus").alias("l_linestatus"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(predicted_status().alias("l_linestatus"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    c = (t.lineitem.select("l_returnflag", sides.alias("s"))
         .groupBy("l_returnflag", F.col("s.l_linestatus").alias("l_linestatus"))
         .agg(F.sum("s.a").cast("long").alias("ma"), F.sum("s.b").cast("long").alias("mb")))
    return c.filter("ma > 0 AND mb > 0").select("l_returnflag", "l_linestatus",
                                               F.least("ma", "mb").alias("common"))


@query("set_diff", "U-DIFF", """
(SELECT o_custkey AS k, 'orders_only' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events))
UNION ALL
(SELECT user_id AS k, 'events_only' AS side FROM (SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders))""")
def set_diff(t: Tables):
    # EXCEPT (distinct, NULL equals NULL) -- Spark plans it as a null-safe anti join.
    o = t.orders.select(F.col("o_custkey").alias("k"))
    e = t.events.select(F.col("user_id").alias("k"))
    return (o.subtract(e).withColumn("side", F.lit("orders_only"))
            .unionByName(e.subtract(o).withColumn("side", F.lit("events_only"))))


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_TIE = [c for c in LINEITEM_COLS if c not in ("l_orderkey", "l_linenumber")]


@query("dedup_lineitem", "U-DEDUP", f"""
SELECT {', '.join(LINEITEM_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' NULLS LAST' for c in _TIE)}) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedup_lineitem(t: Tables):
    """First row per (orderkey, linenumber) under a full tie-break order.

    ``row_number() = 1`` is planned with a partial ``WindowGroupLimit``
    before the shuffle (Spark's window group limit, on by default): every
    map task keeps at most one row per key, so a key repeated a billion
    times is reduced map-side instead of being gathered into one task.
    ``tests/test_plans.py`` checks that the map-side limit is in the plan.
    """
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.asc_nulls_last(c) for c in _TIE])
    return (t.lineitem.select(*LINEITEM_COLS).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


# ---------------------------------------------------------- scalar funcs ----

@query("month_trunc", "F-DTRUNC", """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month FROM orders""")
def month_trunc(t: Tables):
    return t.orders.select("o_orderkey", month_ntz("o_orderdate").alias("month"))


@query("event_hours", "F-EXTRACT", """
SELECT CAST(hour(ts) AS BIGINT) AS hr, count(*) AS n FROM events GROUP BY 1""")
def event_hours(t: Tables):
    return t.events.groupBy(F.hour("ts").cast("long").alias("hr")).agg(F.count(F.lit(1)).alias("n"))


@query("avg_ship_days", "F-EPOCH", """
SELECT o.o_orderstatus, round(avg(epoch(l.l_shipdate - o.o_orderdate) / 86400.0), 6) AS avg_days
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus""")
def avg_ship_days(t: Tables):
    """avg(ship - order) = (sum(ship) - n * order) / n, so lines are reduced to
    one row per order before the join. Exact without overflow: ship times are
    summed as three long parts (days since 1970, seconds in the day, micros in
    the second), each small enough that a key may hold ~10^13 lines.
    A status group exists when some line joins an order of that status."""
    us = epoch_micros("l_shipdate")
    lines = (t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.sum(F.floor(us / 86400000000)).alias("sd"), F.sum(F.floor(F.pmod(us, F.lit(86400000000)) / 1000000)).alias("ss"),
                  F.sum(F.pmod(us, F.lit(1000000))).alias("su"), F.count("l_shipdate").alias("k")))
    o = t.orders.select("o_orderkey", "o_orderstatus", epoch_micros("o_orderdate").alias("od"))
    has = F.col("od").isNotNull() & (F.col("k") > 0)
    dec = "decimal(38,0)"
    diff = (F.col("sd").cast(dec) * 86400000000 + F.col("ss").cast(dec) * 1000000 + F.col("su").cast(dec)
            - F.col("k").cast(dec) * F.col("od").cast(dec))          # per order: one row, decimal is cheap here
    per = (lines.join(o, "o_orderkey").groupBy("o_orderstatus")
           .agg(F.sum(F.when(has, diff)).alias("d"), F.sum(F.when(has, F.col("k"))).alias("n")))
    return per.select("o_orderstatus", F.when(F.col("n") > 0, F.round(F.col("d").cast("double") / F.col("n") / 86400e6, 6))
                      .alias("avg_days"))


@query("ts_add", "F-TSADD", """
SELECT event_id, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS ts_later,
       CAST(ts AS DATE) + CAST(greatest(1, floor(value / 100)) AS INTEGER) AS day_later
FROM events""")
def ts_add(t: Tables):
    secs = F.floor("value").cast("long")
    days = F.greatest(F.lit(1), F.floor(F.col("value") / 100)).cast("int")
    return t.events.select("event_id",
                           F.timestamp_add("SECOND", secs, F.col("ts")).alias("ts_later"),
                           F.date_add(F.to_date("ts"), days).alias("day_later"))


@query("line_total", "F-ARITH", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                  * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DOUBLE) AS total
FROM lineitem""")
def line_total(t: Tables):
    # Money arithmetic in decimals: exact products, half-up rounding, no
    # binary ties -- the same digits in every engine.
    total = money("l_extendedprice") * (1 - money("l_discount", 2, 4)) * (1 + money("l_tax", 2, 4))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.round(total, 2).cast("double").alias("total"))


@query("round6", "F-ROUND", """
SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) / 7, 6) AS DOUBLE) AS share
FROM customer""")
def round6(t: Tables):
    return t.customer.select("c_custkey", F.round(money("c_acctbal") / 7, 6).cast("double").alias("share"))


@query("bucket_price", "F-WHEN", """
SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS bucket,
       count(*) AS n
FROM orders GROUP BY 1""")
def bucket_price(t: Tables):
    b = (F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 150000, "mid")
         .otherwise("high"))
    return t.orders.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("iso_dates", "F-ISO", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ts
FROM orders""")
def iso_dates(t: Tables):
    return t.orders.select("o_orderkey", iso_date("o_orderdate").alias("d"), iso_ts("o_orderdate").alias("ts"))


@query("regex_title", "F-REGEX", """
SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages""")
def regex_title(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query("regex_urls", "F-FINDALL", """
SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1""")
def regex_urls(t: Tables):
    return (t.pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("regex_findall", "F-FINDALL", r"""
WITH known AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS term
                                          FROM benchmark) WHERE term <> ''),
l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages),
x AS (SELECT page_id, lower(regexp_replace(unnest(links), '^/|[^\p{L}]+$', '', 'g')) AS target, unnest(range(1, len(links) + 1)) AS pos FROM l),
f AS (SELECT page_id, target, min(pos) AS pos FROM x WHERE target IN (SELECT term FROM known) GROUP BY 1, 2)
SELECT page_id, string_agg(target, ',' ORDER BY pos) AS known_links FROM f GROUP BY page_id""")
def regex_findall(t: Tables):
    """All link targets of a page (every href, without its leading slash and
    trailing punctuation), kept if known (a term of the benchmark
    vocabulary), de-duplicated in first-seen order. The known set is a
    distributed table (semi join), not a literal list."""
    from quarry.operators.text import term_freq
    known = term_freq(t.benchmark, "item_id", "text").select("term").distinct()
    x = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
                       .alias("pos", "target")).withColumn(
        "target", F.lower(F.regexp_replace("target", r"^/|[^\p{L}]+$", "")))
    first = (x.join(known.withColumnRenamed("term", "target"), "target", "left_semi")
             .groupBy("page_id", "target").agg(F.min("pos").alias("pos")))
    return first.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda s: s["target"]),
                     ",").alias("known_links"))


@query("json_props", "F-JSONARR", """
SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) :: BIGINT AS sum_k,
       count(json_extract_string(props, '$.k')) AS n_k
FROM events GROUP BY event_type""")
def json_props(t: Tables):
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.sum(k.cast("long")).alias("sum_k"), F.count(k).alias("n_k"))


@query("prefix_reject", "F-PREFIX", """
SELECT doc_id, regexp_extract(lower(ltrim(text)), '^([a-z]+)', 1) AS first_word FROM documents
WHERE regexp_matches(lower(ltrim(text)), '^(a|b|c)[a-z]*')""")
def prefix_reject(t: Tables):
    low = F.lower(F.ltrim("text"))
    return (t.documents.filter(low.rlike("^(a|b|c)[a-z]*"))
            .select("doc_id", F.regexp_extract(low, "^([a-z]+)", 1).alias("first_word")))


_START = r"(?is)(?:^|[^\p{L}\p{N}_])((?:select|with)(?:[^\p{L}\p{N}_].*|$))"
_FENCE = r"(?is)```sql\s*(.*?)```"


@query("regex_sql", "F-REGEX", rf"""
WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Here it is: ```sql ' || text || ';; ``` done' ELSE text END AS t
           FROM conversations),
f AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '{_FENCE}') THEN regexp_extract(t, '{_FENCE}', 1) ELSE t END AS s FROM c),
g AS (SELECT conv_id, turn, CASE WHEN regexp_matches(s, '{_START}') THEN regexp_extract(s, '{_START}', 1) ELSE s END AS s FROM f)
SELECT conv_id, turn, nullif(regexp_replace(regexp_replace(s, '^\s+|[;\s]*;\s*$|\s+$', '', 'g'), '\s+$', ''), '') AS sql FROM g""")
def regex_sql(t: Tables):
    """The SQL in an answer: what a ```sql fence holds (else all of it), from the first
    select or with on, without trailing semicolons; NULL if nothing is left.
    Every third conversation gets a fence around its text."""
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Here it is: ```sql "), "text", F.lit(";; ``` done"))) \
        .otherwise(F.col("text"))
    s = t.conversations.select("conv_id", "turn", text.alias("t"))
    s = s.withColumn("s", F.when(F.col("t").rlike(_FENCE), F.regexp_extract("t", _FENCE, 1)).otherwise(F.col("t")))
    s = s.withColumn("s", F.when(F.col("s").rlike(_START), F.regexp_extract("s", _START, 1)).otherwise(F.col("s")))
    tidy = F.regexp_replace(F.regexp_replace("s", r"^\s+|[;\s]*;\s*$|\s+$", ""), r"\s+$", "")
    return s.select("conv_id", "turn", F.nullif(tidy, F.lit("")).alias("sql"))


_NAME = r"[a-z_]+\.[a-z_]+"


@query("json_tables", "F-JSONARR", rf"""
WITH h AS (SELECT page_id, regexp_extract(url, '{_NAME}') AS host, url FROM pages),
valid AS (SELECT host FROM h WHERE host <> '' GROUP BY host HAVING count(*) > 1),
a AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Use ["' || host || '", "no.such", "' || host || '"] here'
                                       WHEN 1 THEN 'Use [' || host || ', broken] and ' || url ELSE url END AS t FROM h),
p AS (SELECT page_id, t, TRY_CAST(regexp_extract(t, '(?s)\[.*?\]') AS JSON) AS j FROM a),
l AS (SELECT page_id, CASE WHEN j IS NOT NULL AND json_array_length(j) > 0 THEN from_json(j, '["VARCHAR"]')
                           ELSE regexp_extract_all(t, '{_NAME}') END AS names FROM p),
x AS (SELECT page_id, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS pos FROM l),
f AS (SELECT page_id, name, min(pos) AS pos FROM x WHERE name IN (SELECT host FROM valid) GROUP BY 1, 2)
SELECT page_id, string_agg(name, ',' ORDER BY pos) AS tables FROM f GROUP BY page_id""")
def json_tables(t: Tables):
    """Names an answer gives as a JSON array, or else its name-like tokens; kept
    if they are known (hosts that occur twice), each once, in order."""
    h = t.pages.select("page_id", F.regexp_extract("url", _NAME, 0).alias("host"), "url")
    valid = h.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("host").alias("name"))
    kind = F.col("page_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit('Use ["'), "host", F.lit('", "no.such", "'), "host", F.lit('"] here'))) \
        .when(kind == 1, F.concat(F.lit("Use ["), "host", F.lit(", broken] and "), "url")).otherwise(F.col("url"))
    a = h.select("page_id", answer.alias("t"))
    parsed = F.from_json(F.regexp_extract("t", r"(?s)\[.*?\]", 0), "array<string>")
    names = F.when(F.size(parsed) > 0, parsed).otherwise(F.regexp_extract_all("t", F.lit(_NAME), F.lit(0)))
    x = a.select("page_id", F.posexplode(names).alias("pos", "name"))
    first = x.join(valid, "name", "left_semi").groupBy("page_id", "name").agg(F.min("pos").alias("pos"))
    return first.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]), ",")
        .alias("tables"))


# The statements that are refused.
DML = ["insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "merge"]
_VERBS = [*DML, "select", "with", "explain"]


@query("dml_guard", "F-PREFIX", f"""
WITH s AS (SELECT '  ' || upper(([{', '.join(repr(v) for v in _VERBS)}])[doc_id % {len(_VERBS)} + 1]) || ' ' || coalesce(text, '') AS sql
           FROM documents),
g AS (SELECT regexp_matches(lower(ltrim(sql)), '^({'|'.join(DML)})') AS refused, length(sql) AS n FROM s)
SELECT refused, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM g GROUP BY refused""")
def dml_guard(t: Tables):
    """Statements that start with one of the nine writing words are refused."""
    verb = F.get(F.array(*[F.lit(v) for v in _VERBS]), (F.col("doc_id") % len(_VERBS)).cast("int"))
    s = t.documents.select(F.concat(F.lit("  "), F.upper(verb), F.lit(" "), F.coalesce("text", F.lit(""))).alias("sql"))
    return (s.groupBy(F.lower(F.ltrim("sql")).rlike("^(" + "|".join(DML) + ")").alias("refused"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sql")).alias("chars")))


@query("str_slug", "F-STR", """
SELECT p_partkey,
       regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
         || '-' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0')
                        ELSE CAST(p_partkey AS VARCHAR) END AS slug,
       upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title
FROM part""")
def str_slug(t: Tables):
    return t.part.select("p_partkey",
                         slug(F.col("p_name"), pad_key(F.col("p_partkey"))).alias("slug"),
                         F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr(F.col("p_name"), F.lit(2))).alias("title"))


def _letter_sql(i: int) -> str:
    letter = f"chr(65 + CAST((c_custkey // {26 ** i}) % 26 AS INTEGER))"
    return letter if i < 4 else f"CASE WHEN c_custkey >= {26 ** i} THEN {letter} ELSE '' END"


@query("base26_codes", "F-BASE26", f"""
SELECT c_custkey, {' || '.join(_letter_sql(i) for i in range(MAX_LETTERS - 1, -1, -1))} AS code FROM customer""")
def base26_codes(t: Tables):
    """Base-26 code of every customer key: four letters, more where the key needs them."""
    return t.customer.select("c_custkey", base26(F.col("c_custkey"), 4).alias("code"))


@query("crc_names", "F-CRC", """
WITH crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
h AS (SELECT c_custkey, c_name, hex(encode(c_name)) AS h FROM customer)
SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]::BIGINT)), 4294967295) END AS crc FROM h, crc""")
def crc_names(t: Tables):
    """CRC-32 of the UTF-8 bytes of a name."""
    return t.customer.select("c_custkey", F.crc32("c_name").alias("crc"))


@query("json_out", "F-JSONOUT", """
SELECT c_custkey, to_json(struct_pack(name := c_name, nation := c_nationkey)) AS json FROM customer""")
def json_out(t: Tables):
    """One compact JSON object per customer; a NULL field is written as null, not dropped."""
    return t.customer.select("c_custkey",
                             F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")),
                                       {"ignoreNullFields": "false"}).alias("json"))
