"""Generator jobs driven by a declaration: a table by its schema, tenants by anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import generate as gen
from quarry.operators import synth as sy
from quarry.plans import synth as fixed
from quarry.plans.registry import query
from quarry.plans.synth import SEED, H, U, _arr_sql, _normal_sql
from quarry.sources.tables import Tables

TABLE = "contacts"
P = gen.POOLS


def null_share(name: str) -> float:
    return dict(fixed.NULL_PROB).get(name, fixed.DEFAULT_NULL)


SETTINGS = gen.Settings(SEED, fixed.REF_DATE, fixed.HISTORY_DAYS, fixed.flag_p, null_share)


# -- SQL of the rules, column by column -----------------------------------------------------

def _s(name: str, part: str = "") -> str:
    return f"{TABLE}.{name}{part}"


def _pick(name: str, pool: list[str], part: str = "") -> str:
    return f"({_arr_sql(pool)})[{H(_s(name, part), 'k')} % {len(pool)} + 1]"


def _draw(name: str, low: int, n: int, part: str = "") -> str:
    return f"({low} + {H(_s(name, part), 'k')} % {n})"


def _logn(name: str, mu: float, sigma: float) -> str:
    return f"exp({mu} + {sigma} * {_normal_sql(_s(name), 'k')})"


def _dec(value: str, p: int, s: int) -> str:
    return f"CAST(round(least({value}, {10.0 ** (p - s) - 10.0 ** -s!r}), {s}) AS DECIMAL({p}, {s}))"


def _dbl(value: str) -> str:
    return f"round(least({value}, {1e12 - 10.0 ** -2!r}), 2)"


def _letters(number: str, width: int) -> str:
    return " || ".join(f"chr(CAST(65 + ({number}) // {26 ** i} % 26 AS INTEGER))" for i in reversed(range(width)))


def _flag(name: str) -> str:
    return f"{U(_s(name), 'k')} < {fixed.flag_p(name)}"


def _ts(name: str) -> str:
    return (f"(TIMESTAMP '{fixed.REF_DATE}' - INTERVAL {fixed.HISTORY_DAYS} DAY"
            f" + to_seconds(CAST(floor({U(_s(name), 'k')} * {fixed.HISTORY_DAYS * 86400}) AS BIGINT)))")


def _uuid(name: str) -> str:
    h = f"md5('{_s(name)}|{SEED}|' || CAST(k AS VARCHAR))"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _title(word: str) -> str:
    return f"upper(left({word}, 1)) || substr({word}, 2)"


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

#: name, type, nullable, metadata, SQL
FIELDS = [
    ("contact_uuid", _S, False, {"kind": "uuid"}, _uuid("contact_uuid")),
    ("stage", _S, False, {"labels": ["lead", "trial", "customer"]}, _pick("stage", ["lead", "trial", "customer"])),
    ("is_active", T.BooleanType(), False, {}, _flag("is_active")),
    ("is_primary", T.BooleanType(), False, {}, _flag("is_primary")),
    ("is_archived", T.BooleanType(), False, {}, _flag("is_archived")),
    ("opted_in", T.BooleanType(), False, {}, _flag("opted_in")),
    ("created_at", T.TimestampNTZType(), False, {}, _ts("created_at")),
    ("last_login_at", T.TimestampNTZType(), True, {}, _ts("last_login_at")),
    ("birthday", T.DateType(), False, {}, f"CAST({_ts('birthday')} AS DATE)"),
    ("last_ip", _S, False, {"kind": "inet"}, " || '.' || ".join(f"CAST({_draw('last_ip', 1, 253, f'.{i}')} AS VARCHAR)" for i in range(4))),
    ("prefs", _S, False, {"kind": "json"},
     f"""'{{"' || {_pick('prefs', gen.JSON_KEYS, '.key')} || '": "' || {_pick('prefs', gen.JSON_VALUES, '.value')} || '"}}'"""),
    ("tags", T.ArrayType(_S), False, {}, "CAST([] AS VARCHAR[])"),
    ("churn_prob", T.DecimalType(5, 4), False, {}, _dec(U(_s("churn_prob"), "k"), 5, 4)),
    ("margin_percent", T.DecimalType(5, 2), False, {}, _dec(f"{U(_s('margin_percent'), 'k')} * 100", 5, 2)),
    ("win_rate", _D, False, {}, _dbl(U(_s("win_rate"), "k"))),
    ("quick_ratio", _D, False, {}, _dbl(U(_s("quick_ratio"), "k"))),
    ("balance", T.DecimalType(14, 2), False, {}, _dec(_logn("balance", *gen.MONEY), 14, 2)),
    ("small_fee", T.DecimalType(4, 2), False, {}, _dec(_logn("small_fee", *gen.MONEY), 4, 2)),
    ("unit_weight", T.DecimalType(12, 4), False, {}, _dec(_logn("unit_weight", *gen.MONEY), 12, 4)),
    ("distance", _D, True, {}, _dbl(_logn("distance", *gen.OTHER_NUMERIC))),
    ("seats", _I, False, {}, _draw("seats", 1, 11)),
    ("progress", _I, False, {}, _draw("progress", 0, 101)),
    ("sort_order", _I, False, {}, "k % 50"),
    ("grace_days", _I, False, {}, _draw("grace_days", 1, 89)),
    ("health_score", T.LongType(), False, {}, _draw("health_score", 1, 5)),
    ("visits", _I, True, {}, _draw("visits", 0, 1000)),
    ("iso2", _S, False, {"maxlen": 2}, _letters("k % 676", 2)),
    ("ticker", _S, False, {"maxlen": 5}, _letters(f"{H(_s('ticker'), 'k')} % {26 ** 3}", 3)),
    ("badge", _S, False, {"maxlen": 6, "unique": True}, _letters(f"k % {26 ** 6}", 6)),
    ("label", _S, False, {"unique": True}, f"{_title(_pick('label', P['word']))} || ' ' || CAST(k AS VARCHAR)"),
    ("email", _S, False, {"unique": True}, f"lower({_pick('email', P['first'], '.first')}) || '.' || "
     f"lower({_pick('email', P['last'], '.last')}) || CAST(k AS VARCHAR) || '@' || {_pick('email', P['domain'], '.domain')}"),
    ("first_name", _S, False, {}, _pick("first_name", P["first"])),
    ("last_name", _S, False, {}, _pick("last_name", P["last"])),
    ("full_name", _S, False, {}, f"{_pick('full_name', P['first'], '.first')} || ' ' || {_pick('full_name', P['last'], '.last')}"),
    ("display_name", _S, False, {}, _pick("display_name", P["company"])),
    ("avatar_url", _S, False, {}, f"'https://' || ({_arr_sql(P['domain'])})[k % {len(P['domain'])} + 1] || '/' || {_pick('avatar_url', P['word'])}"),
    ("page_slug", _S, False, {}, f"{_pick('page_slug', P['word'])} || '-' || CAST(k AS VARCHAR)"),
    ("public_id", _S, False, {}, f"upper(left({_pick('public_id', P['word'])}, 6)) || '-' || CASE WHEN k < 1000000 "
     "THEN lpad(CAST(k AS VARCHAR), 7, '0') ELSE CAST(k AS VARCHAR) END"),
    ("city", _S, False, {}, _pick("city", P["city"])),
    ("line1", _S, False, {}, f"CAST({_draw('line1', 1, 9998, '.house')} AS VARCHAR) || ' ' || {_pick('line1', P['street'])}"),
    ("phone", _S, True, {}, f"'+1' || CAST({_draw('phone', 1_000_000_000, 8_999_999_999)} AS VARCHAR)"),
    ("bio", _S, True, {}, _pick("bio", P["sentence"])),
    ("nickname", _S, True, {}, _pick("nickname", P["word"])),
]

SCHEMA = T.StructType([T.StructField(name, kind, null, meta) for name, kind, null, meta, _ in FIELDS])


def _field_sql(name: str, null: bool, sql: str) -> str:
    return f"CASE WHEN {U(_s(name, '.null'), 'k')} >= {null_share(name)} THEN {sql} END AS {name}" if null else f"{sql} AS {name}"


@query("gen_schema", "G-TEXT", "SELECT c_custkey, " + ", ".join(_field_sql(n, null, sql) for n, _, null, _, sql in FIELDS)
       + " FROM (SELECT c_custkey, c_custkey AS k FROM customer)")
def gen_schema(t: Tables):
    """A contacts table of forty columns and more for the customers' keys, every column by the rule its
    name, type, length and uniqueness give."""
    return gen.columns(t.customer.select("c_custkey"), TABLE, SCHEMA, "c_custkey", "c_custkey", SETTINGS)


@query("gen_accounts", "G-MIX", f"""
WITH s AS (SELECT c_custkey, CAST(floor(exp({fixed.COMPANY_MU} + {fixed.COMPANY_SIGMA} * {_normal_sql('size', 'c_custkey')})) AS BIGINT) + 1
             AS employees, exp({fixed.REVENUE_MU} + {fixed.REVENUE_SIGMA} * {_normal_sql('revenue', 'c_custkey')}) AS each FROM customer)
SELECT c_custkey, employees, round(employees * each, 2) AS annual_revenue FROM s""")
def gen_accounts(t: Tables):
    """Company sizes and annual revenue: revenue per head is lognormal."""
    key = F.col("c_custkey")
    draw = lambda stream, mu, sigma: F.exp(mu + F.lit(sigma) * sy.normal(stream, SEED, key))
    employees = F.floor(draw("size", fixed.COMPANY_MU, fixed.COMPANY_SIGMA)).cast("long") + 1
    each = draw("revenue", fixed.REVENUE_MU, fixed.REVENUE_SIGMA)
    return t.customer.select("c_custkey", employees.alias("employees"), F.round(employees * each, 2).alias("annual_revenue"))


# -- anchors --------------------------------------------------------------------------------

PRIORITY = ["accounts", "orders"]


def _zipf_sql(stream: str, key: str, n: str, a: float) -> str:
    return (f"least(CAST(floor(pow(1.0 + {U(stream, key)} * (pow(CAST({n} AS DOUBLE) + 1, {1 - a!r}) - 1), {1 / (1 - a)!r})) AS BIGINT)"
            f" - 1, {n} - 1)")


def _anchored_sql(table: str, fk: str, parent: str, pick: str, rows: str) -> str:
    return f"""{table}0 AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM ({rows}) WHERE key IS NOT NULL),
{table} AS (SELECT c.key, '{fk}' AS anchor, p.key AS parent_key, p.tenant, c.idx FROM {table}0 c JOIN {parent} p ON {pick})"""


@query("gen_anchors", "G-ANCHOR", f"""
WITH accounts AS (SELECT c_custkey AS key, CAST(NULL AS VARCHAR) AS anchor, CAST(NULL AS BIGINT) AS parent_key,
    1 + {_zipf_sql('accounts.tenant', 'c_custkey', '(SELECT count(*) FROM nation)', gen.ZIPF_TENANT)} AS tenant,
    row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer WHERE c_custkey IS NOT NULL),
pool AS (SELECT key, tenant, row_number() OVER (ORDER BY {H('agents.account_id.anchor', 'key')}, key) - 1 AS idx FROM accounts),
{_anchored_sql('agents', 'account_id', 'pool', 'p.idx = c.idx', 'SELECT s_suppkey AS key FROM supplier')},
{_anchored_sql('orders_', 'account_id', 'accounts',
               f"p.idx = {_zipf_sql('orders.account_id.anchor', 'c.key', '(SELECT count(*) FROM accounts)', gen.ZIPF_ACTIVITY)}",
               'SELECT o_orderkey AS key FROM orders')},
{_anchored_sql('lines', 'order_id', 'orders_',
               f"p.idx = {_zipf_sql('lines.order_id.anchor', 'c.key', '(SELECT count(*) FROM orders_)', gen.ZIPF_ACTIVITY)}",
               'SELECT DISTINCT l_orderkey * 10 + l_linenumber AS key FROM lineitem')},
{_anchored_sql('parts', 'agent_id', 'agents',
               f"p.idx = {_zipf_sql('parts.agent_id.anchor', 'c.key', '(SELECT count(*) FROM agents)', gen.ZIPF_ACTIVITY)}",
               'SELECT p_partkey AS key FROM part')}
SELECT 'accounts' AS table_name, key, anchor, parent_key, tenant FROM accounts
UNION ALL SELECT 'agents', key, anchor, parent_key, tenant FROM agents
UNION ALL SELECT 'orders', key, anchor, parent_key, tenant FROM orders_
UNION ALL SELECT 'lines', key, anchor, parent_key, tenant FROM lines
UNION ALL SELECT 'parts', key, anchor, parent_key, tenant FROM parts""")
def gen_anchors(t: Tables):
    """Tenants down a chain of tables: accounts have no tenant-scoped parent; an agent has an
    account of its own; orders take an account before an agent; lines inherit from orders, three
    deep; parts have two keys to agents and take the first by name."""
    lines = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")).distinct()
    tables = [
        gen.Table("lines", lines, "key", {"agent_id": "agents", "order_id": "orders"}),
        gen.Table("orders", t.orders, "o_orderkey", {"account_id": "accounts", "agent_id": "agents"}),
        gen.Table("agents", t.supplier, "s_suppkey", {"account_id": "accounts", "manager_id": "agents"}, frozenset({"account_id"})),
        gen.Table("parts", t.part, "p_partkey", {"maker_id": "agents", "agent_id": "agents", "region_id": "regions"}),
        gen.Table("accounts", t.customer, "c_custkey", {"tenant_id": "tenants"})]
    n_tenants = t.dim("nation").count()
    done = gen.anchored(tables, n_tenants, PRIORITY, SEED)
    return reduce(DataFrame.unionByName, [
        rows.select(F.lit(name).alias("table_name"), F.col("key").cast("long").alias("key"), "anchor",
                    F.col("parent_key").cast("long").alias("parent_key"), F.col("tenant").cast("long").alias("tenant"))
        for name, rows in done.items()])
