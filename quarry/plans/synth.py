"""Synthetic table generation driven by the fixture tables' keys.

Each query draws from md5 streams keyed by real table keys, so the work
grows with the tables and the oracle recomputes the same numbers in DuckDB:
``CAST('0x' || substr(md5('<stream>|<seed>|' || key), 1, 15) AS BIGINT)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.scalar import HASH_RANGE, hash_int, pad_key, slug
from quarry.operators import synth as sy
from quarry.operators.windows import global_row_number
from quarry.plans.quality import row_counts
from quarry.plans.registry import query
from quarry.session import materialise
from quarry.sources.tables import FIXED_SIZE_DIMENSIONS, TABLE_NAMES, Tables

SEED = 42

# Fixed values of the generator being rebuilt ------------------------------
SCALE_MULT = [("tiny", 0.002), ("small", 0.05), ("bench", 1.0), ("large", 5.0)]
# Reference tables keep their size at every scale (only "tiny" shrinks them, to a quarter, at least 5 rows).
HISTORY_DAYS = 730
REF_DATE = "2026-06-01"
EVENT_NAMES = ["page_view", "product_viewed", "add_to_cart", "checkout_started", "order_completed", "search",
               "signup", "login", "feature_used", "subscription_started", "support_ticket_opened", "email_opened"]
EVENT_ZIPF_A = 1.1
PAYMENT_MIX = [("failed", 0.079), ("refunded", 0.13)]   # cumulative thresholds; rest "captured"
PLAN_CODES = ["free", "starter", "pro", "business", "enterprise"]
MONEY_MU, MONEY_SIGMA = 3.0, 1.1
NULL_P_FK, NULL_P_PARENT = 0.15, 0.5
BOOL_P = 0.85
TAX_RATE = "0.08"
SHIPPING = ["0", "4.99", "9.99", "14.99"]
DISCOUNTS = ["0", "0", "0", "0.1", "0.2"]
# Probability of NULL by column name; any other nullable column: DEFAULT_NULL.
NULL_PROB = [("deleted_at", 0.96), ("archived_at", 0.9), ("cancelled_at", 0.85), ("canceled_at", 0.85),
             ("refunded_at", 0.9), ("closed_at", 0.6), ("resolved_at", 0.6), ("solved_at", 0.6), ("revoked_at", 0.9),
             ("used_at", 0.7), ("confirmed_at", 0.4), ("accepted_at", 0.6), ("completed_at", 0.5),
             ("delivered_at", 0.35), ("shipped_at", 0.25), ("paid_at", 0.2), ("last_login_at", 0.3),
             ("last_used_at", 0.4), ("trial_ends_at", 0.7), ("line2", 0.6), ("phone", 0.4), ("bio", 0.7),
             ("middle_name", 0.8), ("notes", 0.6), ("description", 0.3), ("parent_id", 0.7)]
DEFAULT_NULL = 0.2
# Share of true by name prefix, first match; any other flag: 0.5. Flags that one row per parent may hold stay false.
FLAG_P = [("is_default", 0.0), ("is_primary", 0.0), ("is_preferred", 0.0), ("is_main", 0.0), ("is_active", 0.85),
          ("is_enabled", 0.85), ("succeeded", 0.85), ("is_public", 0.85), ("is_", 0.4), ("", 0.5)]
# Whole numbers by role: lowest value and number of values.
INT_RANGES = [("quantity", 1, 11), ("percent", 0, 101), ("shelf_days", 1, 89), ("score", 1, 5), ("other", 0, 1000)]
POSITIONS = 50
SUBSCRIPTION_MIX = [("canceled", 0.84), ("past_due", 0.18)]    # tried in this order; rest "active"
COMPANY_MU, COMPANY_SIGMA, REVENUE_MU, REVENUE_SIGMA = 3.5, 1.5, 11.0, 0.6
CURRENCIES = ("USD EUR GBP JPY CAD AUD CHF CNY SEK NZD MXN SGD HKD NOK KRW INR BRL ZAR DKK PLN TWD THB MYR IDR HUF "
              "CZK ILS CLP PHP AED").split()
LOCALES = ("en-US en-GB de-DE fr-FR it-IT es-ES pt-BR nl-NL sv-SE ja-JP zh-CN ko-KR pl-PL da-DK fi-FI").split()
COUNTRIES = ("US GB DE FR IT ES CA AU JP CN IN BR MX NL SE CH PL IE SG KR NO DK FI BE AT PT NZ ZA AE IL HK TW TH MY "
             "ID PH CL CZ HU AR").split()
EUROPE = "GB DE FR IT ES NL SE CH PL IE NO DK FI BE AT PT CZ HU".split()
NORTH_AMERICA, SOUTH_AMERICA = ["US", "CA", "MX"], ["BR", "AR", "CL"]
# ---------------------------------------------------------------------------
ZIPF_K, ZIPF_A = 50, 1.6
DEDUP_A, DEDUP_B = 50, 60


def H(stream: str, key: str) -> str:
    """SQL spelling of hash_int."""
    return f"CAST('0x' || substr(md5('{stream}|{SEED}|' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def U(stream: str, key: str) -> str:
    return f"({H(stream, key)} / CAST({HASH_RANGE:.0f} AS DOUBLE))"


def _u(stream: str, key: str):
    return sy.uniform(stream, SEED, F.col(key))


def _target_sql(tb: str, s: str, m: float) -> str:
    if tb in FIXED_SIZE_DIMENSIONS:
        f = 0.25 if s == "tiny" else 1.0
        return f"CAST(greatest(5, floor(count(*) * {f})) AS BIGINT)"
    return f"CAST(greatest(1, floor(count(*) * {m})) AS BIGINT)"


@query("gen_rows", "G-ROWS", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{s}' AS scale, {_target_sql(tb, s, m)} AS target_rows "
    f"FROM {tb}" for tb in TABLE_NAMES for s, m in SCALE_MULT))
def gen_rows(t: Tables):
    """Target rows per (table, scale): max(1, floor(rows x multiplier)); fixed
    reference tables keep their size (tiny: a quarter, at least 5)."""
    scales = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(m).alias("mult")) for s, m in SCALE_MULT]))
    fixed = F.col("table_name").isin(*FIXED_SIZE_DIMENSIONS)
    tiny = F.col("s.scale") == "tiny"
    target = F.when(fixed, F.greatest(F.lit(5), F.floor(F.col("n") * F.when(tiny, 0.25).otherwise(1.0)))) \
        .otherwise(F.greatest(F.lit(1), F.floor(F.col("n") * F.col("s.mult"))))
    return (row_counts(t).select("table_name", "n", scales.alias("s"))
            .select("table_name", "s.scale", target.cast("long").alias("target_rows")))


@query("gen_uniform", "G-STREAM", f"SELECT o_orderkey, {U('u', 'o_orderkey')} AS u FROM orders")
def gen_uniform(t: Tables):
    return t.orders.select("o_orderkey", _u("u", "o_orderkey").alias("u"))


@query("gen_zipf", "G-ZIPF", f"""
WITH cdf AS (SELECT r, sum(pow(r, -{ZIPF_A})) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) / sum(pow(r, -{ZIPF_A})) OVER () AS hi
             FROM range(1, {ZIPF_K + 1}) t(r)),
b AS (SELECT r, coalesce(lag(hi) OVER (ORDER BY r), 0.0) AS lo, CASE WHEN r = {ZIPF_K} THEN 2.0 ELSE hi END AS hi FROM cdf),
d AS (SELECT {U('zipf', 'o_orderkey')} AS u FROM orders)
SELECT CAST(b.r AS INTEGER) AS zipf_rank, count(*) AS n FROM d JOIN b ON d.u >= b.lo AND d.u < b.hi GROUP BY b.r""")
def gen_zipf(t: Tables):
    """One bounded-Zipf draw (ranks 1..50, a=1.6) per order, by inverse CDF."""
    r = sy.zipf_rank(_u("zipf", "o_orderkey"), ZIPF_K, ZIPF_A)
    return t.orders.groupBy(r.alias("zipf_rank")).agg(F.count(F.lit(1)).alias("n"))


_EV_CDF = sy.cumulative(sy.zipf_weights(len(EVENT_NAMES), EVENT_ZIPF_A))


@query("gen_category", "G-CAT", f"""
WITH v AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, '{n}')" for i, n in enumerate(EVENT_NAMES))}) t(r, name)),
cdf AS (SELECT r, name, sum(pow(r, -{EVENT_ZIPF_A})) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)
                     / sum(pow(r, -{EVENT_ZIPF_A})) OVER () AS hi FROM v),
b AS (SELECT name, coalesce(lag(hi) OVER (ORDER BY r), 0.0) AS lo,
             CASE WHEN r = {len(EVENT_NAMES)} THEN 2.0 ELSE hi END AS hi FROM cdf),
d AS (SELECT {U('event', 'event_id')} AS u FROM events)
SELECT b.name AS event_name, count(*) AS n FROM d JOIN b ON d.u >= b.lo AND d.u < b.hi GROUP BY b.name""")
def gen_category(t: Tables):
    """Event name per event row, weights rank^-1.1 over the 12-name vocabulary."""
    name = sy.weighted_choice(_u("event", "event_id"), EVENT_NAMES, sy.zipf_weights(len(EVENT_NAMES), EVENT_ZIPF_A))
    return t.events.groupBy(name.alias("event_name")).agg(F.count(F.lit(1)).alias("n"))


def _normal_sql(stream, key):
    u1 = f"(({H(stream + '.1', key)} + 0.5) / CAST({HASH_RANGE:.0f} AS DOUBLE))"
    u2 = f"({H(stream + '.2', key)} / CAST({HASH_RANGE:.0f} AS DOUBLE))"
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


@query("gen_money", "G-NUM", f"""
WITH d AS (SELECT CAST(floor({U('decile', 'o_orderkey')} * 10) AS BIGINT) AS decile,
                  round(least(exp({MONEY_MU} + {MONEY_SIGMA} * {_normal_sql('money', 'o_orderkey')}), {10.0 ** 12 - 0.01!r}), 2) AS amount
           FROM orders)
SELECT decile, count(*) AS n, round(sum(amount), 2) AS total, max(amount) AS max_amount FROM d GROUP BY decile""")
def gen_money(t: Tables):
    """Lognormal money per order (mu=3, sigma=1.1), clipped to numeric(14,2)."""
    amount = sy.lognormal_money("money", SEED, F.col("o_orderkey"), MONEY_MU, MONEY_SIGMA)
    decile = F.floor(_u("decile", "o_orderkey") * 10).cast("long")
    return (t.orders.select(decile.alias("decile"), amount.alias("amount")).groupBy("decile")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total"),
                 F.max("amount").alias("max_amount")))


@query("gen_time", "G-TIME", f"""
WITH d AS (SELECT TIMESTAMP '{REF_DATE}' - INTERVAL {HISTORY_DAYS} DAY
                  + to_seconds(CAST(floor({U('time', 'event_id')} * {HISTORY_DAYS * 86400}) AS BIGINT)) AS ts FROM events)
SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n, min(ts) AS first_ts FROM d GROUP BY 1""")
def gen_time(t: Tables):
    """Uniform whole-second timestamps in the 730 days before 2026-06-01."""
    from quarry.functions.scalar import month_ntz
    start = F.lit(REF_DATE).cast("timestamp_ntz") - F.expr(f"INTERVAL {HISTORY_DAYS} DAYS")
    secs = F.floor(_u("time", "event_id") * (HISTORY_DAYS * 86400)).cast("long")
    ts = F.timestamp_add("SECOND", secs, start)
    return (t.events.select(ts.alias("ts")).groupBy(month_ntz("ts").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts")))


@query("gen_bool", "G-BOOL", f"""
SELECT count(*) FILTER (WHERE {U('flag', 'c_custkey')} < {BOOL_P}) AS n_true, count(*) AS n FROM customer""")
def gen_bool(t: Tables):
    flag = sy.bernoulli("flag", SEED, F.col("c_custkey"), BOOL_P)
    return t.customer.agg(F.count_if(flag).alias("n_true"), F.count(F.lit(1)).alias("n"))


@query("gen_text", "G-TEXT", """
WITH s AS (SELECT regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
                  || '-' || CAST(p_partkey AS VARCHAR) AS slug,
                  regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base
           FROM part)
SELECT count(*) AS n, count(DISTINCT slug) AS n_distinct_salted, count(DISTINCT base) AS n_distinct_unsalted FROM s""")
def gen_text(t: Tables):
    """Unique text by salting with the id: `name-id` slugs never collide."""
    s = t.part.select(slug(F.col("p_name"), F.col("p_partkey")).alias("slug"), slug(F.col("p_name")).alias("base"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slug").alias("n_distinct_salted"),
                 F.count_distinct("base").alias("n_distinct_unsalted"))


@query("gen_uuid", "G-UUID", f"""
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
       || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT c_custkey, md5('uuid|{SEED}|' || CAST(c_custkey AS VARCHAR)) AS h FROM customer)""")
def gen_uuid(t: Tables):
    return t.customer.select("c_custkey", sy.seeded_uuid("uuid", SEED, F.col("c_custkey")).alias("uuid"))


@query("gen_fk", "G-FK", f"""
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx, count(*) OVER () AS n
           FROM customer WHERE c_custkey IS NOT NULL),
n AS (SELECT DISTINCT n FROM p)
SELECT o.o_orderkey, p.c_custkey AS parent_custkey
FROM orders o, n JOIN p ON p.idx = {H('fk', 'o.o_orderkey')} % n.n""")
def gen_fk(t: Tables):
    """Uniform parent by dense index: hash mod n picks the index-th key, so a
    parent is always found, gaps in the keys or not."""
    keys = t.customer.select("c_custkey").filter("c_custkey IS NOT NULL")
    parents = materialise(sy.dense_index(keys, [], ["c_custkey"]))
    n = parents.agg(F.count(F.lit(1))).scalar()
    child = t.orders.select("o_orderkey", F.pmod(hash_int("fk", SEED, F.col("o_orderkey")), n).alias("_idx"))
    return child.join(parents, "_idx").select("o_orderkey", F.col("c_custkey").alias("parent_custkey"))


@query("gen_fk_tenant", "G-FKTENANT", f"""
WITH p AS (SELECT c_custkey, c_nationkey,
                  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx,
                  count(*) OVER (PARTITION BY c_nationkey) AS cnt
           FROM customer),
cnt AS (SELECT DISTINCT c_nationkey, cnt FROM p),
ch AS (SELECT o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT ch.o_orderkey, p.c_custkey AS parent_custkey, ch.c_nationkey AS tenant
FROM ch JOIN cnt USING (c_nationkey)
JOIN p ON p.c_nationkey = ch.c_nationkey AND p.idx = {H('fk', 'ch.o_orderkey')} % cnt.cnt""")
def gen_fk_tenant(t: Tables):
    """Parent drawn within the child's tenant (nation of its order's customer).

    Parents get a dense per-tenant index (numbered over ranges, so a hot tenant
    is ranked by many tasks), written once; the child picks index hash mod
    tenant size and equi-joins on (tenant, index). No id pool reaches the driver.
    """
    parents = materialise(sy.dense_index(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"]))
    sizes = parents.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("_cnt"))
    child = (t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
             .join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").drop("c_custkey")
             .join(sizes, "c_nationkey")
             .withColumn("_idx", F.pmod(hash_int("fk", SEED, F.col("o_orderkey")), F.col("_cnt"))))
    p = parents.select("c_nationkey", "_idx", F.col("c_custkey").alias("parent_custkey"))
    return child.join(p, ["c_nationkey", "_idx"]).select("o_orderkey", "parent_custkey",
                                                         F.col("c_nationkey").alias("tenant"))


@query("gen_fk_unique", "G-FK1TO1", f"""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY {H('pick', 'c_custkey')}, c_custkey) - 1 AS idx FROM customer),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier)
SELECT s.s_suppkey, c.c_custkey FROM s JOIN c USING (idx)""")
def gen_fk_unique(t: Tables):
    """One-to-one: every supplier gets a distinct customer, the customers
    taken in hash order. Both sides are numbered over ranges; equi-join."""
    c = sy.dense_index(t.customer.select("c_custkey", hash_int("pick", SEED, F.col("c_custkey")).alias("h")), [],
                       ["h", "c_custkey"])
    s = sy.dense_index(t.supplier.select("s_suppkey"), [], ["s_suppkey"])
    return s.select("s_suppkey", "_idx").join(c.select("c_custkey", "_idx"), "_idx").select("s_suppkey", "c_custkey")


@query("gen_anchor", "G-ANCHOR", """
SELECT c.c_nationkey AS tenant, count(*) AS n_lines
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
GROUP BY c.c_nationkey""")
def gen_anchor(t: Tables):
    """Tenant inherited from the anchor parent: lineitem <- order <- customer."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    oc = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return (lines.join(oc, "o_orderkey").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
            .groupBy(F.col("c_nationkey").alias("tenant")).agg(F.sum("k").alias("n_lines")))


@query("gen_natural_fk", "G-NATFK", f"""
WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS idx, count(*) OVER () AS nb
           FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)),
nb AS (SELECT DISTINCT nb FROM b),
d AS (SELECT o_orderkey, {U('natnull', 'o_orderkey')} < 0.1 AS is_null, {H('natfk', 'o_orderkey')} % nb.nb AS idx FROM orders, nb)
SELECT CASE WHEN d.is_null THEN NULL ELSE b.p_brand END AS brand, count(*) AS n
FROM d JOIN b ON b.idx = d.idx GROUP BY 1""")
def gen_natural_fk(t: Tables):
    """FK to a natural key (brand code), NULL with probability 0.1."""
    # a natural key is never NULL: NULL brands are not part of the code list
    codes = t.part.select("p_brand").filter(F.col("p_brand").isNotNull()).distinct()
    brands = global_row_number(codes, [F.asc("p_brand")], "_r").withColumn("_idx", F.col("_r") - 1)
    nb = brands.agg(F.count(F.lit(1))).scalar()
    d = t.orders.select(_u("natnull", "o_orderkey").__lt__(0.1).alias("is_null"),
                        F.pmod(hash_int("natfk", SEED, F.col("o_orderkey")), nb).alias("_idx"))
    j = d.join(brands.select("p_brand", "_idx"), "_idx")
    return j.groupBy(F.when(~F.col("is_null"), F.col("p_brand")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("gen_nulls", "G-NULLS", f"""
SELECT 'c_nationkey' AS col, CAST({NULL_P_FK} AS DOUBLE) AS p,
       count(*) FILTER (WHERE {U('null.fk', 'c_custkey')} < {NULL_P_FK} OR c_nationkey IS NULL) AS n_null,
       count(*) AS n FROM customer
UNION ALL
SELECT 'parent_custkey', CAST({NULL_P_PARENT} AS DOUBLE), count(*) FILTER (WHERE {U('null.parent', 'c_custkey')} < {NULL_P_PARENT}), count(*)
FROM customer""")
def gen_nulls(t: Tables):
    """NULLs by column-role probability: FK 15 %, parent/assignee 50 %."""
    fk = F.when(~sy.bernoulli("null.fk", SEED, F.col("c_custkey"), NULL_P_FK), F.col("c_nationkey"))
    parent = F.when(~sy.bernoulli("null.parent", SEED, F.col("c_custkey"), NULL_P_PARENT), F.col("c_custkey") + 1)
    g = t.customer.select(fk.alias("a"), parent.alias("b"))
    row = g.agg(F.count_if(F.col("a").isNull()).alias("na"), F.count_if(F.col("b").isNull()).alias("nb"),
                F.count(F.lit(1)).alias("n"))
    return row.select(F.explode(F.array(
        F.struct(F.lit("c_nationkey").alias("col"), F.lit(NULL_P_FK).alias("p"), F.col("na").alias("n_null"), "n"),
        F.struct(F.lit("parent_custkey").alias("col"), F.lit(NULL_P_PARENT).alias("p"), F.col("nb").alias("n_null"),
                 "n"))).alias("r")).select("r.*")


@query("gen_cohere", "G-COHERE", f"""
WITH d AS (SELECT o_orderdate AS s, o_orderdate + to_days(CAST(1 + {H('cohere', 'o_orderkey')} % 200 AS INTEGER)) AS e
           FROM orders)
SELECT count(*) AS n, count(*) FILTER (WHERE e < s) AS violations,
       CAST(max(datediff('day', s, e)) AS BIGINT) AS max_days FROM d""")
def gen_cohere(t: Tables):
    """Paired columns kept coherent: end = start + 1..200 days."""
    days = (F.pmod(hash_int("cohere", SEED, F.col("o_orderkey")), F.lit(200)) + 1).cast("int")
    d = t.orders.select(F.col("o_orderdate").alias("s"), F.timestamp_add("DAY", days, F.col("o_orderdate")).alias("e"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e") < F.col("s")).alias("violations"),
                 F.max(F.datediff(F.col("e"), F.col("s"))).cast("long").alias("max_days"))


@query("gen_order_math", "G-MONEY", f"""
WITH l AS (SELECT l_orderkey,
                  sum(round(CAST(l_quantity AS DECIMAL(10,0)) * CAST(l_extendedprice AS DECIMAL(18,2))
                            * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)) AS subtotal
           FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey, subtotal, round(subtotal * {TAX_RATE}, 2) AS tax,
             ([{', '.join(f'CAST({x} AS DECIMAL(18,2))' for x in SHIPPING)}])[{H('ship', 'l_orderkey')} % {len(SHIPPING)} + 1] AS shipping,
             round(subtotal * ([{', '.join(f'CAST({x} AS DECIMAL(3,2))' for x in DISCOUNTS)}])[{H('disc', 'l_orderkey')} % {len(DISCOUNTS)} + 1], 2)
               AS discount FROM l)
SELECT l_orderkey, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax, CAST(shipping AS DOUBLE) AS shipping,
       CAST(discount AS DOUBLE) AS discount, CAST(subtotal + tax + shipping - discount AS DOUBLE) AS grand_total FROM m""")
def gen_order_math(t: Tables):
    """Order totals that add up: grand = subtotal + 8 % tax + shipping - discount,
    lines = quantity x price x (1 - discount); exact decimal arithmetic."""
    line = F.round(F.col("l_quantity").cast("decimal(10,0)") * F.col("l_extendedprice").cast("decimal(18,2)")
                   * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)
    l = t.lineitem.groupBy("l_orderkey").agg(F.sum(line).alias("subtotal"))
    def one_of(stream, values, kind):
        at = F.pmod(hash_int(stream, SEED, F.col("l_orderkey")), F.lit(len(values)))
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at.cast("int"))

    m = l.select("l_orderkey", "subtotal",
                 F.round(F.col("subtotal") * F.lit(TAX_RATE).cast("decimal(3,2)"), 2).alias("tax"),
                 one_of("ship", SHIPPING, "decimal(18,2)").alias("shipping"),
                 F.round(F.col("subtotal") * one_of("disc", DISCOUNTS, "decimal(3,2)"), 2).alias("discount"))
    return m.select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "shipping", "discount")],
                    (F.col("subtotal") + F.col("tax") + F.col("shipping") - F.col("discount")).cast("double")
                    .alias("grand_total"))


@query("gen_status", "G-MIX", f"""
SELECT CASE WHEN u < {PAYMENT_MIX[0][1]} THEN '{PAYMENT_MIX[0][0]}' WHEN u < {PAYMENT_MIX[1][1]} THEN '{PAYMENT_MIX[1][0]}'
            ELSE 'captured' END AS status, count(*) AS n
FROM (SELECT {U('pay', 'o_orderkey')} AS u FROM orders) GROUP BY 1""")
def gen_status(t: Tables):
    u = _u("pay", "o_orderkey")
    st = F.lit("captured")
    for name, hi in reversed(PAYMENT_MIX):
        st = F.when(u < hi, F.lit(name)).otherwise(st)
    return t.orders.groupBy(st.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("gen_reference", "G-REF", f"""
SELECT ({'[' + ', '.join(repr(c) for c in PLAN_CODES) + ']'})[c_custkey % 5 + 1] AS code,
       upper(substr(({'[' + ', '.join(repr(c) for c in PLAN_CODES) + ']'})[c_custkey % 5 + 1], 1, 1))
       || substr(({'[' + ', '.join(repr(c) for c in PLAN_CODES) + ']'})[c_custkey % 5 + 1], 2) || ' Plan' AS name,
       count(*) AS n
FROM customer GROUP BY 1, 2""")
def gen_reference(t: Tables):
    """Real reference values cycled over ids (plan codes over customers)."""
    code = F.get(F.array(*[F.lit(c) for c in PLAN_CODES]), (F.col("c_custkey") % len(PLAN_CODES)).cast("int"))
    return (t.customer.groupBy(code.alias("code"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("code", F.concat(F.initcap("code"), F.lit(" Plan")).alias("name"), "n"))


@query("gen_dedup", "G-DEDUP", f"""
WITH d AS (SELECT o_orderkey, {H('da', 'o_orderkey')} % {DEDUP_A} AS a, {H('db', 'o_orderkey')} % {DEDUP_B} AS b FROM orders)
SELECT count(*) AS n_target, count(DISTINCT (a, b)) AS n_kept, sum(o_orderkey) FILTER (WHERE first) AS kept_key_sum
FROM (SELECT *, o_orderkey = min(o_orderkey) OVER (PARTITION BY a, b) AS first FROM d)""")
def gen_dedup(t: Tables):
    """Composite-unique (a, b) collisions dropped, first (lowest key) kept:
    min() per pair is a partial aggregate, so repeated pairs shrink map-side."""
    d = t.orders.select("o_orderkey",
                        F.pmod(hash_int("da", SEED, F.col("o_orderkey")), F.lit(DEDUP_A)).alias("a"),
                        F.pmod(hash_int("db", SEED, F.col("o_orderkey")), F.lit(DEDUP_B)).alias("b"))
    kept = d.groupBy("a", "b").agg(F.min("o_orderkey").alias("k"), F.count(F.lit(1)).alias("m"))
    return kept.agg(F.sum("m").alias("n_target"), F.count(F.lit(1)).alias("n_kept"), F.sum("k").alias("kept_key_sum"))


def _arr_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cycled(values, key: str):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


@query("gen_integers", "G-NUM", " UNION ALL ".join(
    f"SELECT '{name}' AS role, min({lo} + {H('int.' + name, 'p_partkey')} % {n}) AS lo, "
    f"max({lo} + {H('int.' + name, 'p_partkey')} % {n}) AS hi, CAST(sum({lo} + {H('int.' + name, 'p_partkey')} % {n}) AS BIGINT) AS total "
    f"FROM part" for name, lo, n in INT_RANGES)
    + f" UNION ALL SELECT 'position', min(p_partkey % {POSITIONS}), max(p_partkey % {POSITIONS}), "
      f"CAST(sum(p_partkey % {POSITIONS}) AS BIGINT) FROM part")
def gen_integers(t: Tables):
    """Whole numbers by the role a column's name gives it; positions cycle. One pass over parts."""
    key = F.col("p_partkey")
    roles = [(name, lo + F.pmod(hash_int("int." + name, SEED, key), F.lit(n))) for name, lo, n in INT_RANGES]
    roles.append(("position", key % POSITIONS))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("role"), v.cast("long").alias("v")) for n, v in roles]))
    return (t.part.select(cells.alias("c")).groupBy(F.col("c.role").alias("role"))
            .agg(F.min("c.v").alias("lo"), F.max("c.v").alias("hi"), F.sum("c.v").alias("total")))


FLAG_NAMES = ["is_default", "is_primary", "is_active", "is_enabled", "succeeded", "is_public", "is_archived", "is_paid",
              "verified", "opted_in"]


def flag_p(name: str) -> float:
    return next(p for prefix, p in FLAG_P if name.startswith(prefix))


@query("gen_flags", "G-BOOL", " UNION ALL ".join(
    f"SELECT '{n}' AS flag, count(*) FILTER (WHERE {U('flag.' + n, 'c_custkey')} < {flag_p(n)}) AS n_true, count(*) AS n "
    f"FROM customer" for n in FLAG_NAMES))
def gen_flags(t: Tables):
    """Flags by the share their name's prefix gives; one-per-parent flags are never set."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("flag"),
                                         sy.bernoulli("flag." + n, SEED, F.col("c_custkey"), flag_p(n)).alias("v"))
                                for n in FLAG_NAMES]))
    return (t.customer.select(cells.alias("c")).groupBy(F.col("c.flag").alias("flag"))
            .agg(F.count_if("c.v").alias("n_true"), F.count(F.lit(1)).alias("n")))


NULLABLE = [*NULL_PROB, ("website", DEFAULT_NULL)]


@query("gen_null_names", "G-NULLS", " UNION ALL ".join(
    f"SELECT '{n}' AS col, count(*) FILTER (WHERE {U('null.' + n, 'o_orderkey')} < {p}) AS n_null, count(*) AS n FROM orders"
    for n, p in NULLABLE))
def gen_null_names(t: Tables):
    """NULLs by column name, a row per order and column, counted in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("col"),
                                         sy.bernoulli("null." + n, SEED, F.col("o_orderkey"), p).alias("v"))
                                for n, p in NULLABLE]))
    return (t.orders.select(cells.alias("c")).groupBy(F.col("c.col").alias("col"))
            .agg(F.count_if("c.v").alias("n_null"), F.count(F.lit(1)).alias("n")))


@query("gen_reference_codes", "G-REF", f"""
SELECT ({_arr_sql(CURRENCIES)})[c_custkey % {len(CURRENCIES)} + 1] AS currency,
       ({_arr_sql(LOCALES)})[c_custkey % {len(LOCALES)} + 1] AS locale,
       CASE WHEN iso2 IN ({', '.join(repr(c) for c in NORTH_AMERICA)}) THEN 'North America'
            WHEN iso2 IN ({', '.join(repr(c) for c in SOUTH_AMERICA)}) THEN 'South America'
            WHEN iso2 IN ({', '.join(repr(c) for c in EUROPE)}) THEN 'Europe'
            WHEN iso2 IS NOT NULL THEN 'Asia' END AS continent, count(*) AS n
FROM (SELECT c_custkey, ({_arr_sql(COUNTRIES)})[c_custkey % {len(COUNTRIES)} + 1] AS iso2 FROM customer)
GROUP BY 1, 2, 3""")
def gen_reference_codes(t: Tables):
    """Currency, locale and country codes cycled over customers; continents follow the country."""
    iso2 = F.col("iso2")
    continent = (F.when(iso2.isin(NORTH_AMERICA), "North America").when(iso2.isin(SOUTH_AMERICA), "South America")
                 .when(iso2.isin(EUROPE), "Europe").when(iso2.isNotNull(), "Asia"))
    c = t.customer.select(_cycled(CURRENCIES, "c_custkey").alias("currency"), _cycled(LOCALES, "c_custkey").alias("locale"),
                          _cycled(COUNTRIES, "c_custkey").alias("iso2"))
    return c.groupBy("currency", "locale", continent.alias("continent")).agg(F.count(F.lit(1)).alias("n"))


@query("gen_subscriptions", "G-MIX", f"""
WITH s AS (SELECT c_custkey, {U('sub', 'c_custkey')} AS u,
                  CAST(floor(exp({COMPANY_MU} + {COMPANY_SIGMA} * {_normal_sql('size', 'c_custkey')})) AS BIGINT) + 1 AS employees
           FROM customer)
SELECT CASE WHEN u < {SUBSCRIPTION_MIX[0][1]} THEN '{SUBSCRIPTION_MIX[0][0]}'
            WHEN u < {SUBSCRIPTION_MIX[1][1]} THEN '{SUBSCRIPTION_MIX[1][0]}' ELSE 'active' END AS status,
       count(*) AS n, CAST(sum(employees) AS BIGINT) AS employees, min(employees) AS smallest FROM s GROUP BY 1""")
def gen_subscriptions(t: Tables):
    """Subscription states by threshold, and skewed company sizes (lognormal, at least 1)."""
    u, status = F.col("u"), F.lit("active")
    for name, hi in reversed(SUBSCRIPTION_MIX):
        status = F.when(u < hi, F.lit(name)).otherwise(status)
    size = F.floor(F.exp(COMPANY_MU + F.lit(COMPANY_SIGMA) * sy.normal("size", SEED, F.col("c_custkey")))).cast("long") + 1
    s = t.customer.select(_u("sub", "c_custkey").alias("u"), size.alias("employees"))
    return s.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("employees").alias("employees"),
                                                 F.min("employees").alias("smallest"))


@query("gen_contacts", "G-TEXT", f"""
SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z]+', '', 'g')) || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       upper(left(regexp_replace(c_name, '[^A-Za-z]+', '', 'g'), 6)) || '-' ||
         CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 7 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0')
              ELSE CAST(c_custkey AS VARCHAR) END AS code,
       '+1' || CAST(1000000000 + {H('phone', 'c_custkey')} % 9000000000 AS VARCHAR) AS phone,
       CAST(1 + {H('street', 'c_custkey')} % 9998 AS VARCHAR) || ' ' || c_mktsegment AS street
FROM customer""")
def gen_contacts(t: Tables):
    """Emails and codes made unique by the key, ten-digit phones, house numbers."""
    word = F.regexp_replace("c_name", "[^A-Za-z]+", "")
    key = F.col("c_custkey")
    number = F.pmod(hash_int("phone", SEED, key), F.lit(9_000_000_000)) + F.lit(1_000_000_000)
    house = F.pmod(hash_int("street", SEED, key), F.lit(9998)) + 1
    return t.customer.select(
        "c_custkey", F.concat(F.lower(word), key.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.upper(F.substring(word, 1, 6)), F.lit("-"), pad_key(key, 7)).alias("code"),
        F.concat(F.lit("+1"), number.cast("string")).alias("phone"),
        F.concat(house.cast("string"), F.lit(" "), F.col("c_mktsegment")).alias("street"))


@query("gen_dedup_groups", "G-DEDUP", f"""
WITH d AS (SELECT o_orderkey, o_custkey, o_orderpriority, {H('ga', 'o_orderkey')} % 90 AS a, {H('gb', 'o_orderkey')} % 80 AS b
           FROM orders WHERE o_orderkey IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY o_orderkey) AS r FROM d) WHERE r = 1)
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM one)
WHERE r = 1""")
def gen_dedup_groups(t: Tables):
    """Several unique groups in turn: a row that an earlier group drops does not
    count for a later one. Each turn is a map-side limited row_number() = 1."""
    rows = t.orders.filter("o_orderkey IS NOT NULL").select(
        "o_orderkey", "o_custkey", "o_orderpriority",
        F.pmod(hash_int("ga", SEED, F.col("o_orderkey")), F.lit(90)).alias("a"),
        F.pmod(hash_int("gb", SEED, F.col("o_orderkey")), F.lit(80)).alias("b"))
    for group in (["a", "b"], ["o_custkey", "o_orderpriority"]):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("o_orderkey"))) \
            .filter("_r = 1").drop("_r")
    return rows.select("o_orderkey")
