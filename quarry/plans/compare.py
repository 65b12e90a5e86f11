"""Result comparison jobs on result sets derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import compare as cmp
from quarry.plans.registry import query
from quarry.plans.relational import PREDICTED_STATUS_SQL, predicted_status
from quarry.sources.tables import Tables


def _status_counts(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _questions(t: Tables, names):
    return t.spark.createDataFrame([(n, True) for n in names], "qid string, answered boolean")


_WHOLE_SQL = "CAST({c} AS VARCHAR)"
#: A double rounded to 6 places, as plain digits without trailing zeros.
_DOUBLE_SQL = "regexp_replace(regexp_replace(CAST(CAST(round({c}, 6) AS DECIMAL(38, 6)) AS VARCHAR), '0+$', ''), '\\.$', '')"


@query("compare_norm", "C-NORM", f"""
SELECT 's:' || o_orderstatus AS c0, 'n:' || {_DOUBLE_SQL.format(c='o_totalprice')} AS c1,
       's:' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS c2, 'n:' || {_WHOLE_SQL.format(c='o_orderkey')} AS c3
FROM orders""")
def compare_norm(t: Tables):
    """Normalised cells of a mixed-type result (text, double, timestamp, int)."""
    return cmp.normalise(t.orders.select("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderkey"))


_G = "(SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders)"


def _same(a: str, b: str) -> str:
    a, b = f"SELECT * FROM ({a})", f"SELECT * FROM ({b})"
    return (f"((SELECT count(*) FROM ({a} EXCEPT ALL {b})) = 0 AND "
            f"(SELECT count(*) FROM ({b} EXCEPT ALL {a})) = 0)")


@query("compare_bag", "C-EX", f"""
SELECT 'equal' AS case_name, {_same(f'SELECT * FROM {_G}', f'SELECT * FROM {_G}')} AS verdict
UNION ALL SELECT 'permuted', {_same(f'SELECT k, c, s, p FROM {_G}', f'SELECT k, c, s, p FROM (SELECT p, s, k, c FROM {_G})')}
UNION ALL SELECT 'duplicated', {_same(f'SELECT * FROM {_G}',
                                      f'SELECT * FROM {_G} UNION ALL SELECT * FROM {_G} WHERE s = $$F$$')}
UNION ALL SELECT 'missing_rows', {_same(f'SELECT * FROM {_G}', f'SELECT * FROM {_G} WHERE s <> $$P$$')}
UNION ALL SELECT 'shifted', {_same(f'SELECT * FROM {_G}', f'SELECT k + 1, c, s, p FROM {_G}')}
""".replace("$$", "'"))
def compare_bag(t: Tables):
    """The whole orders table against itself, a permuted, a duplicated, a
    shortened and a shifted copy: five questions judged together, one scan a side."""
    key, cust, status, price = (F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    g = [key, cust, status, price]
    names = ["equal", "permuted", "duplicated", "missing_rows", "shifted"]
    gold = cmp.keyed_rows(t.orders, [(F.lit(n), None, g) for n in names], "g")
    pred = cmp.keyed_rows(t.orders, [
        (F.lit("equal"), None, g), (F.lit("permuted"), None, [price, status, key, cust]),
        (F.lit("duplicated"), None, g), (F.lit("duplicated"), status == "F", g),
        (F.lit("missing_rows"), status != "P", g), (F.lit("shifted"), None, [key + 1, cust, status, price])], "p")
    return cmp.judge(_questions(t, names), gold, pred).select(F.col("qid").alias("case_name"), "verdict")


QUESTIONS = 100

_ASKED = f"""asked AS (
  SELECT coalesce(o_custkey % {QUESTIONS}, 0) AS q, o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS r
  FROM orders),
answered AS (
  SELECT q, k, s, CASE WHEN q % 5 = 0 AND k % 977 = 0 THEN p + 0.01 ELSE p END AS p, r FROM asked
  WHERE NOT (q % 7 = 0 AND s IS NOT NULL AND s = 'P'))"""


@query("compare_questions", "C-EX", f"""
WITH {_ASKED},
g AS (SELECT q, k, s, p, r, count(*) AS m FROM asked GROUP BY ALL),
a AS (SELECT q, k, s, p, r, count(*) AS m FROM answered GROUP BY ALL),
d AS (SELECT coalesce(g.q, a.q) AS q, count(*) FILTER (WHERE g.m IS DISTINCT FROM a.m) AS n FROM g FULL JOIN a
      ON g.q = a.q AND g.k IS NOT DISTINCT FROM a.k AND g.s IS NOT DISTINCT FROM a.s
     AND g.p IS NOT DISTINCT FROM a.p AND g.r IS NOT DISTINCT FROM a.r GROUP BY 1)
SELECT q.q::VARCHAR AS qid, (SELECT count(*) FROM asked x WHERE x.q = q.q) AS n_gold,
       (SELECT count(*) FROM answered x WHERE x.q = q.q) AS n_pred, coalesce(d.n, 0) = 0 AS verdict
FROM range({QUESTIONS}) q(q) LEFT JOIN d USING (q)""")
def compare_questions(t: Tables):
    """A hundred questions over the whole orders table: the prediction's columns are
    turned by the question's number, some questions lack rows or have other prices."""
    q = F.coalesce(F.col("o_custkey") % QUESTIONS, F.lit(0))
    key, status, price, priority = (F.col(c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    off = F.when((q % 5 == 0) & (key % 977 == 0), price + 0.01).otherwise(price)
    cols = [key, status, off, priority]
    kept = ~F.coalesce((q % 7 == 0) & (status == "P"), F.lit(False))
    gold = cmp.keyed_rows(t.orders, [(q, None, [key, status, price, priority])], "g")
    pred = cmp.keyed_rows(t.orders, [(q, kept & (q % 4 == turn), cols[turn:] + cols[:turn]) for turn in range(4)], "p")
    asked = t.spark.range(QUESTIONS).select(F.col("id").cast("string").alias("qid"), F.lit(True).alias("answered"))
    return cmp.judge(asked, gold, pred).select("qid", "n_gold", "n_pred", "verdict")


_M = ("(SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n "
      "FROM orders GROUP BY 1)")


@query("compare_ordered", "C-ORDERED", f"""
WITH g AS (SELECT row_number() OVER (ORDER BY month) AS pos, month, n FROM {_M}),
     p AS (SELECT row_number() OVER (ORDER BY n DESC, month) AS pos, month, n FROM {_M})
SELECT 'same_order' AS case_name, {_same('SELECT * FROM g', 'SELECT * FROM g')} AS verdict
UNION ALL SELECT 'other_order', {_same('SELECT * FROM g', 'SELECT * FROM p')}
UNION ALL SELECT 'other_order_unordered', {_same('SELECT month, n FROM g', 'SELECT month, n FROM p')}""")
def compare_ordered(t: Tables):
    from quarry.functions.scalar import month_ntz
    # Monthly counts: ~80 rows, so the position windows are over a bounded result.
    m = t.orders.groupBy(month_ntz("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    g = m.withColumn("pos", F.row_number().over(Window.orderBy("month")))
    p = m.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "month")))
    ordered = cmp.judge(_questions(t, ["same_order", "other_order"]),
                        cmp.keyed({"same_order": g, "other_order": g}, "g", "pos"),
                        cmp.keyed({"same_order": g, "other_order": p}, "p", "pos"))
    bags = cmp.judge(_questions(t, ["other_order_unordered"]), cmp.keyed({"other_order_unordered": g.drop("pos")}, "g"),
                     cmp.keyed({"other_order_unordered": p.drop("pos")}, "p"))
    return ordered.unionByName(bags).select(F.col("qid").alias("case_name"), "verdict")


@query("soft_f1", "C-SOFTF1", """
WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS m FROM orders GROUP BY 1, 2),
     p AS (SELECT o_orderstatus, o_orderpriority, count(*) AS m FROM orders o
           JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY 1, 2)
SELECT round(2.0 * (SELECT sum(least(g.m, p.m)) FROM g JOIN p
                      ON g.o_orderstatus IS NOT DISTINCT FROM p.o_orderstatus
                     AND g.o_orderpriority IS NOT DISTINCT FROM p.o_orderpriority)
       / ((SELECT sum(m) FROM g) + (SELECT sum(m) FROM p)), 6) AS soft_f1""")
def soft_f1(t: Tables):
    gold = t.orders.select("o_orderstatus", "o_orderpriority")
    building = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    pred = t.orders.join(building, "o_custkey", "left_semi").select("o_orderstatus", "o_orderpriority")
    judged = cmp.judge(_questions(t, ["q"]), cmp.keyed({"q": gold}, "g"), cmp.keyed({"q": pred}, "p"), "most")
    return judged.select(F.round("soft_f1", 6).alias("soft_f1"))


_TURNS = "(VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) t(i, j, k)"


@query("soft_f1_questions", "C-SOFTF1", f"""
WITH l AS (SELECT coalesce(l_suppkey % 20, 0) AS q, l_returnflag AS f, l_linestatus AS s, l_quantity > 25 AS b,
                  l_orderkey % 3 AS z FROM lineitem),
g AS (SELECT q, f, s, b, count(*) AS m FROM l GROUP BY ALL),
a AS (SELECT q, [CASE WHEN b THEN 'n:1' WHEN NOT b THEN 'n:0' END, 's:' || f, 's:' || s] AS c, m FROM g),
p AS (SELECT q, [CASE WHEN b THEN 'n:1' WHEN NOT b THEN 'n:0' END, 's:' || CASE WHEN z = 0 THEN s ELSE f END,
                 's:' || CASE WHEN q % 3 = 0 AND z = 1 THEN f ELSE s END] AS c, count(*) AS m FROM l GROUP BY ALL),
r AS (SELECT p.q, i, j, k, [c[i], c[j], c[k]] AS c, sum(m) AS m FROM p, {_TURNS} GROUP BY ALL),
n AS (SELECT r.q, i, j, k, sum(least(a.m, r.m)) AS common FROM r JOIN a ON a.q = r.q AND a.c IS NOT DISTINCT FROM r.c GROUP BY ALL),
best AS (SELECT q, max(common)::BIGINT AS common FROM n GROUP BY q),
size AS (SELECT q, sum(m)::BIGINT AS rows FROM g GROUP BY q)
SELECT q::VARCHAR AS qid, coalesce(common, 0) AS common, round(coalesce(common, 0) / rows::DOUBLE, 6) AS soft_f1
FROM size LEFT JOIN best USING (q)""")
def soft_f1_questions(t: Tables):
    """Partial credit per question over the whole lineitem table: the columns are in
    another order, and some cells of the prediction are wrong."""
    q, z = F.coalesce(F.col("l_suppkey") % 20, F.lit(0)), F.col("l_orderkey") % 3
    flag, status, big = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity") > 25
    wrong = F.when(z == 0, status).otherwise(flag)
    gold = cmp.keyed_rows(t.lineitem, [(q, None, [flag, status, big])], "g")
    pred = cmp.keyed_rows(t.lineitem, [(q, None, [big, wrong, F.when((q % 3 == 0) & (z == 1), flag).otherwise(status)])], "p")
    asked = gold.select("qid", F.lit(True).alias("answered")).distinct()
    return cmp.judge(asked, gold, pred, "most").select("qid", "common", F.round("soft_f1", 6).alias("soft_f1"))


@query("bag_diff", "C-DIFF", f"""
WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS m FROM lineitem GROUP BY 1, 2),
     b AS (SELECT l_returnflag, {PREDICTED_STATUS_SQL} AS l_linestatus, count(*) AS m FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag,
       coalesce(a.l_linestatus, b.l_linestatus) AS l_linestatus,
       coalesce(a.m, 0) AS n_left, coalesce(b.m, 0) AS n_right,
       CASE WHEN b.m IS NULL THEN 'left_only' WHEN a.m IS NULL THEN 'right_only' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag
                   AND a.l_linestatus IS NOT DISTINCT FROM b.l_linestatus
WHERE coalesce(a.m, 0) <> coalesce(b.m, 0)""")
def bag_diff(t: Tables):
    """Keyed report of the rows whose multiplicity differs between the
    recorded (flag, status) bag and the predicted one, both over every line."""
    left = cmp.normalise(t.lineitem.select("l_returnflag", "l_linestatus"))
    right = cmp.normalise(t.lineitem.select("l_returnflag", predicted_status().alias("l_linestatus")))
    d = cmp.bag_diff(left, right)

    def cell(c):  # undo the tag
        return F.substr(F.col(c), F.lit(3))
    return d.select(cell("r0").alias("l_returnflag"), cell("r1").alias("l_linestatus"), "n_left", "n_right", "status")


@query("compare_subset", "C-SUBSET", """
WITH g AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
     p AS (SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n, o_orderstatus FROM orders GROUP BY 3)
SELECT (SELECT count(*) FROM (SELECT o_orderstatus, n FROM g EXCEPT ALL SELECT o_orderstatus, n FROM p)) = 0
       AS contained""")
def compare_subset(t: Tables):
    gold = _status_counts(t)
    pred = t.orders.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"),
                                                 F.count(F.lit(1)).alias("n")) \
        .select("total", "n", "o_orderstatus")
    judged = cmp.judge(_questions(t, ["q"]), cmp.keyed({"q": gold}, "g"), cmp.keyed({"q": pred}, "p"), "inside")
    return judged.select(F.col("verdict").alias("contained"))


_PLACES = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j" for i in range(1, 6) for j in range(1, 6) if i != j)


@query("subset_questions", "C-SUBSET", f"""
WITH o AS (SELECT coalesce(o_custkey % 25, 0) AS q, o_orderstatus AS s, o_orderpriority AS r, o_orderkey % 2 AS z,
                  o_totalprice > 100000 AS b FROM orders),
g AS (SELECT q, ['s:' || s, 's:' || r] AS c, count(*) AS m FROM o WHERE z = 0 GROUP BY ALL),
w AS (SELECT q, ['n:' || z, 's:' || r, CASE WHEN b THEN 'n:1' WHEN NOT b THEN 'n:0' END, 's:' || s, 's:' || r] AS c FROM o
      WHERE NOT (q % 4 = 0 AND z = 0 AND b IS NOT NULL AND b)),
p AS (SELECT q, i, j, [c[i], c[j]] AS c, count(*) AS m FROM w, ({_PLACES}) GROUP BY ALL),
n AS (SELECT p.q, i, j, sum(least(g.m, p.m)) AS common FROM p JOIN g ON g.q = p.q AND g.c IS NOT DISTINCT FROM p.c GROUP BY ALL),
best AS (SELECT q, max(common) AS common FROM n GROUP BY q),
size AS (SELECT q, sum(m) AS rows FROM g GROUP BY q)
SELECT q::VARCHAR AS qid, coalesce(common, 0) = rows AS contained FROM size LEFT JOIN best USING (q)""")
def subset_questions(t: Tables):
    """Two gold columns looked for among five prediction columns of few values, two of
    them equal, per question over the whole orders table; some predictions lack rows."""
    q, z = F.coalesce(F.col("o_custkey") % 25, F.lit(0)), F.col("o_orderkey") % 2
    status, priority, big = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice") > 100000
    kept = ~F.coalesce((q % 4 == 0) & (z == 0) & big, F.lit(False))
    gold = cmp.keyed_rows(t.orders, [(q, z == 0, [status, priority])], "g")
    pred = cmp.keyed_rows(t.orders, [(q, kept, [z, priority, big, status, priority])], "p")
    asked = gold.select("qid", F.lit(True).alias("answered")).distinct()
    return cmp.judge(asked, gold, pred, "inside").select("qid", F.col("verdict").alias("contained"))


@query("multi_state", "C-MULTISTATE", """
WITH s AS (SELECT user_id, event_id % 3 AS state, bool_and(event_type <> 'error') AS ex
           FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS n_states, bool_and(ex) AS ex_all FROM s GROUP BY user_id""")
def multi_state(t: Tables):
    s = (t.events.groupBy("user_id", (F.col("event_id") % 3).alias("state"))
         .agg(F.bool_and(F.col("event_type") != "error").alias("ex")))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_states"), F.bool_and("ex").alias("ex_all"))
