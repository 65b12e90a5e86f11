"""Synthetic tables from their declaration: columns by schema, tenants by anchors.

``columns`` makes a value for every field of a schema from its name, type, length
and uniqueness, so a new table needs no code: the first rule that fits a
field makes its column. All draws are md5 of (table.column, seed, key), so
a value never depends on partitioning or on other columns.

``anchored`` assigns rows of tenant-scoped tables to tenants: a table inherits the
tenant of one of its parents, its anchor, chosen by a priority list of tables and
then by the key's name; parents come before children. Parents are drawn with a
Zipf-like skew, or one-to-one where the key is unique and there are parents enough. A table
without such a parent draws its tenants with a Zipf-like skew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalar import base26, hash_int, pad_key
from quarry.operators import synth as sy
from quarry.session import materialise
from quarry.sources.tables import spread

# Fixed values of the rules -------------------------------------------------
MONEY_NAMES = ["amount", "total", "subtotal", "price", "balance", "cost", "fee", "revenue", "mrr", "arr", "tax", "discount",
               "credit", "debit", "paid", "due", "value", "rate"]
MONEY, OTHER_NUMERIC = (3.0, 1.1), (2.0, 1.0)      # mu and sigma of the lognormals
#: Names of whole numbers (any of these parts), lowest value and number of values; any other: 0 to 999.
INTEGERS = [(["quantity", "qty", "count", "units", "seats"], 1, 11), (["percent", "pct", "rollout", "progress"], 0, 101)]
DAYS, SCORES, ANY_INTEGER = (1, 89), (1, 5), (0, 1000)
POSITION_NAMES, POSITIONS = ["position", "sort_order", "ordinal", "depth", "step", "rank"], 50
SHORT_CODES = ["iso2", "iso3", "code", "key", "sku", "symbol"]
LONG_CODES = ["sku", "code", "key", "prefix", "token_hash", "hashed_key", "hashed_token", "secret_hash", "public_id"]
COMPANY_NAMES = ["name", "contact_name", "display_name"]
URL_NAMES = ["url", "avatar_url", "website", "target_url", "endpoint"]
STREET_NAMES, PHONE_NAMES = ["line1", "line2", "street", "address"], ["phone", "phone_number"]
SENTENCE_PARTS = ["description", "bio", "note", "body", "message", "content", "comment", "summary", "subject", "title", "text",
                  "reason"]
JSON_KEYS = ["source", "channel", "device", "version", "country", "plan"]
JSON_VALUES = ["web", "mobile", "api", "ios", "android", "v1", "v2", "us", "eu"]
ZIPF_TENANT, ZIPF_ACTIVITY = 1.6, 1.3
# ---------------------------------------------------------------------------

# Words that texts are made of.
POOLS = {
    "first": ["Ada", "Bela", "Cleo", "Dario", "Edith", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Kira", "Luca", "Mina"],
    "last": ["Abel", "Brandt", "Costa", "Duarte", "Engel", "Fontana", "Gruber", "Holm", "Ivers", "Jansen", "Keller"],
    "word": ["amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "harbor", "island", "jetty", "kettle", "lagoon",
             "meadow", "nectar", "orchard", "pebble", "quartz"],
    "company": ["Abel Works", "Brandt Supply", "Costa Foods", "Duarte Mills", "Engel Freight", "Fontana Glass", "Gruber Paper"],
    "domain": ["example.com", "example.net", "example.org"],
    "city": ["Aarhus", "Bergen", "Cadiz", "Dresden", "Evora", "Ferrara", "Ghent", "Hobart", "Izmir"],
    "street": ["Harbor Road", "Mill Lane", "Orchard Street", "Station Square", "Garden Row"],
    "sentence": ["Arrived in good order.", "Asked for a second sample.", "Waiting for the new labels.", "Paid by transfer.",
                 "Please call before noon."],
}


@dataclass(frozen=True)
class Draw:
    """What a rule draws from: the column's own stream of numbers for each row."""
    stream: str
    seed: int
    key: Column
    number: Column      # the row's number, for values that must be unique

    def below(self, n: int, part: str = "") -> Column:
        return F.pmod(hash_int(self.stream + part, self.seed, self.key), F.lit(n))

    def unit(self, part: str = "") -> Column:
        return sy.uniform(self.stream + part, self.seed, self.key)

    def lognormal(self, mu: float, sigma: float) -> Column:
        return F.exp(F.lit(mu) + F.lit(sigma) * sy.normal(self.stream, self.seed, self.key))

    def pick(self, values: list[str], part: str = "") -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), self.below(len(values), part).cast("int"))


def _any_of(name: str, parts: list[str]) -> bool:
    return any(p in name for p in parts)


def _numeric(f: T.StructField, d: Draw) -> Column:
    scale = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else 2
    if "prob" in f.name:
        value = d.unit()
    elif _any_of(f.name, ["percent", "pct"]):
        value = d.unit() * 100
    elif _any_of(f.name, ["rate", "ratio"]):
        value = d.unit()
    else:
        value = d.lognormal(*(MONEY if scale == 4 or _any_of(f.name, MONEY_NAMES) else OTHER_NUMERIC))
    cap = 10.0 ** (f.dataType.precision - scale) if isinstance(f.dataType, T.DecimalType) else 1e12
    return F.round(F.least(value, F.lit(cap - 10.0 ** -scale)), scale).cast(f.dataType)


def _integer(f: T.StructField, d: Draw) -> Column:
    for parts, low, n in INTEGERS:
        if _any_of(f.name, parts):
            return (d.below(n) + low).cast(f.dataType)
    if f.name in POSITION_NAMES:
        return F.pmod(d.number, F.lit(POSITIONS)).cast(f.dataType)
    low, n = DAYS if f.name.endswith("_days") else SCORES if _any_of(f.name, ["score", "rating"]) else ANY_INTEGER
    return (d.below(n) + low).cast(f.dataType)


def _short_text(f: T.StructField, d: Draw) -> Column:
    """Codes that fit a length of eight at most: numbered ones, or up to three letters."""
    width = f.metadata["maxlen"]
    if f.metadata.get("unique") or f.name in SHORT_CODES:
        return base26(F.pmod(d.number, F.lit(26 ** width)), width)
    width = min(width, 3)
    return base26(d.below(26 ** width), width)


def _email(f: T.StructField, d: Draw) -> Column:
    return F.concat(F.lower(d.pick(POOLS["first"], ".first")), F.lit("."), F.lower(d.pick(POOLS["last"], ".last")),
                    d.number.cast("string"), F.lit("@"), d.pick(POOLS["domain"], ".domain"))


def _url(f: T.StructField, d: Draw) -> Column:
    domain = F.get(F.array(*[F.lit(v) for v in POOLS["domain"]]), F.pmod(d.number, F.lit(len(POOLS["domain"]))).cast("int"))
    return F.concat(F.lit("https://"), domain, F.lit("/"), d.pick(POOLS["word"]))


def _long_code(f: T.StructField, d: Draw) -> Column:
    return F.concat(F.upper(F.substring(d.pick(POOLS["word"]), 1, 6)), F.lit("-"), pad_key(d.number, 7))


def _person(f: T.StructField, d: Draw) -> Column:
    return F.concat_ws(" ", d.pick(POOLS["first"], ".first"), d.pick(POOLS["last"], ".last"))


#: Rules of texts, tried in this order: which fields, and how.
TEXT_RULES: list[tuple[str, Callable[[T.StructField], bool], Callable[[T.StructField, Draw], Column]]] = [
    ("short code", lambda f: f.metadata.get("maxlen", 99) <= 8 and not _any_of(f.name, ["email", "url"]), _short_text),
    ("unique words", lambda f: f.metadata.get("unique", False) and "email" not in f.name,
     lambda f, d: F.concat(F.initcap(d.pick(POOLS["word"])), F.lit(" "), d.number.cast("string"))),
    ("email", lambda f: "email" in f.name, _email),
    ("first name", lambda f: f.name == "first_name", lambda f, d: d.pick(POOLS["first"])),
    ("last name", lambda f: f.name == "last_name", lambda f, d: d.pick(POOLS["last"])),
    ("full name", lambda f: f.name == "full_name", _person),
    ("company", lambda f: f.name in COMPANY_NAMES, lambda f, d: d.pick(POOLS["company"])),
    ("url", lambda f: f.name.endswith("_url") or f.name in URL_NAMES, _url),
    ("slug", lambda f: f.name == "slug" or f.name.endswith("_slug"),
     lambda f, d: F.concat(d.pick(POOLS["word"]), F.lit("-"), d.number.cast("string"))),
    ("long code", lambda f: f.name in LONG_CODES, _long_code),
    ("city", lambda f: f.name == "city", lambda f, d: d.pick(POOLS["city"])),
    ("street", lambda f: f.name in STREET_NAMES,
     lambda f, d: F.concat_ws(" ", (d.below(9998, ".house") + 1).cast("string"), d.pick(POOLS["street"]))),
    ("phone", lambda f: f.name in PHONE_NAMES,
     lambda f, d: F.concat(F.lit("+1"), (d.below(9_000_000_000 - 1) + F.lit(1_000_000_000)).cast("string"))),
    ("sentence", lambda f: _any_of(f.name, SENTENCE_PARTS), lambda f, d: d.pick(POOLS["sentence"])),
    ("word", lambda f: True, lambda f, d: d.pick(POOLS["word"])),
]


def text_rule(f: T.StructField) -> str:
    """The name of the rule that makes a text field."""
    return next(name for name, fits, _ in TEXT_RULES if fits(f))


def _text(f: T.StructField, d: Draw) -> Column:
    return next(make for _, fits, make in TEXT_RULES if fits(f))(f, d)


def _inet(f: T.StructField, d: Draw) -> Column:
    return F.concat_ws(".", *[(d.below(253, f".{i}") + 1).cast("string") for i in range(4)])


def _json(f: T.StructField, d: Draw) -> Column:
    return F.concat(F.lit('{"'), d.pick(JSON_KEYS, ".key"), F.lit('": "'), d.pick(JSON_VALUES, ".value"), F.lit('"}'))


def _time(f: T.StructField, d: Draw, ref_date: str, days: int) -> Column:
    start = F.lit(ref_date).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return F.timestamp_add("SECOND", F.floor(d.unit() * (days * 86400)).cast("long"), start).cast(f.dataType)


@dataclass(frozen=True)
class Settings:
    """What a schema does not say: seed, the time window, and the shares by column name."""
    seed: int
    ref_date: str
    history_days: int
    flag_share: Callable[[str], float]
    null_share: Callable[[str], float]


def column(f: T.StructField, table: str, key: Column, number: Column, s: Settings) -> Column:
    """The value of one field. Metadata: labels (of an enumeration), kind ("uuid", "inet", "json"),
    maxlen, unique. Nullable fields that are not unique are NULL at their name's share."""
    d = Draw(f"{table}.{f.name}", s.seed, key, number)
    kind = f.metadata.get("kind")
    if "labels" in f.metadata:
        value = d.pick(f.metadata["labels"])
    elif kind == "uuid":
        value = sy.seeded_uuid(d.stream, s.seed, key)
    elif kind == "inet":
        value = _inet(f, d)
    elif kind == "json":
        value = _json(f, d)
    elif isinstance(f.dataType, T.BooleanType):
        value = d.unit() < F.lit(s.flag_share(f.name))
    elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        value = _time(f, d, s.ref_date, s.history_days)
    elif isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
        value = _numeric(f, d)
    elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        value = _integer(f, d)
    elif isinstance(f.dataType, T.ArrayType):
        value = F.array().cast(f.dataType)
    else:
        value = _text(f, d)
    if f.nullable and not f.metadata.get("unique"):
        value = F.when(sy.uniform(d.stream + ".null", s.seed, key) >= F.lit(s.null_share(f.name)), value)
    return value.alias(f.name)


def columns(rows: DataFrame, table: str, schema: T.StructType, key: str, number: str, s: Settings) -> DataFrame:
    """``key`` and a column per field of ``schema`` for each row: one projection, of a scan's keys that are
    dealt to all cores first if it has fewer partitions."""
    rows = spread(rows.select(*dict.fromkeys([key, number])))
    return rows.select(key, *[column(f, table, F.col(key), F.col(number), s) for f in schema.fields])


# -- tenants ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Table:
    """A tenant-scoped table: its rows' keys, its parents by foreign key, and which keys are unique."""
    name: str
    rows: DataFrame
    key: str
    parents: dict[str, str] = field(default_factory=dict)
    unique: frozenset[str] = frozenset()


def zipf_index(u: Column, n: Column, a: float) -> Column:
    """0 to n - 1, an index r with a chance proportional to the integral of x^-a from r + 1 to r + 2:
    for a number of ranks that comes from data, where no table of weights can be written out."""
    top = F.pow(n.cast("double") + 1, F.lit(1 - a))
    x = F.pow(F.lit(1.0) + u * (top - 1), F.lit(1 / (1 - a)))
    return F.least(F.floor(x).cast("long") - 1, n.cast("long") - 1)


def pick_anchor(parents: dict[str, str], priority: list[str], scoped: set[str], own: str) -> str | None:
    """The foreign key whose parent's tenant a row inherits: the first table of ``priority`` that is
    a parent, else the first key by name; parents without tenants, and the table itself, do not count."""
    usable = {fk: t for fk, t in parents.items() if t in scoped and t != own}
    for table in priority:
        for fk in sorted(usable):
            if usable[fk] == table:
                return fk
    return min(usable, default=None)


def dependency_order(tables: list[Table]) -> list[Table]:
    """Parents before children, ties by name; a reference to the table itself does not count."""
    names, placed, out = {t.name for t in tables}, set(), []
    while len(out) < len(tables):
        ready = [t for t in tables if t.name not in placed
                 and {p for p in t.parents.values() if p in names and p != t.name} <= placed]
        if not ready:
            raise ValueError(f"tables refer to each other: {sorted(names - placed)}")
        out.append(min(ready, key=lambda t: t.name))
        placed.add(out[-1].name)
    return out


def anchored(tables: list[Table], n_tenants: int, priority: list[str], seed: int) -> dict[str, DataFrame]:
    """table -> written (key, anchor, parent_key, tenant, _idx, _cnt) rows."""
    done: dict[str, DataFrame] = {}
    for t in dependency_order(tables):
        rows = sy.dense_index(t.rows.select(F.col(t.key).alias("key")).filter("key is not null"), [], ["key"])
        fk = pick_anchor(t.parents, priority, set(done), t.name)
        if fk is None:
            u = sy.uniform(f"{t.name}.tenant", seed, F.col("key"))
            got = rows.select("key", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("long").alias("parent_key"),
                              (zipf_index(u, F.lit(n_tenants), ZIPF_TENANT) + 1).alias("tenant"), "_idx", "_cnt")
        else:
            parent = done[t.parents[fk]]
            stream = f"{t.name}.{fk}.anchor"
            n_parent = parent.count()
            if fk in t.unique and rows.count() <= n_parent:
                order = parent.select("key", "tenant", hash_int(stream, seed, F.col("key")).alias("h"))
                pool, at = sy.dense_index(order, [], ["h", "key"]), F.col("_idx")
            else:
                pool, at = parent, zipf_index(sy.uniform(stream, seed, F.col("key")), F.lit(n_parent), ZIPF_ACTIVITY)
            pool = pool.select(F.col("_idx").alias("_at"), F.col("key").alias("parent_key"), "tenant")
            got = (rows.withColumn("_at", at).join(pool, "_at")
                   .select("key", F.lit(fk).alias("anchor"), "parent_key", "tenant", "_idx", "_cnt"))
        done[t.name] = materialise(got)
    return done
