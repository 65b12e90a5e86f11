"""Data-quality rules and a planner that evaluates many in few scans.

A ``Rule`` is given by its violating rows. A ``RowRule`` is a predicate over the
rows of a table, which may look at parents along declared ``Link``s. The planner
(``counts``) gathers the row rules of each table, left-joins the parents they
need once, tagged with whether a parent was found, and counts all of the
table's rules in one aggregate. A table that is both checked and looked at as a
parent is scanned once: its joined frame is written and read by both. Like
a primary key, a parent's key is declared unique (check that by a rule of its
own); otherwise a child row counts once for each parent row.

The report lists the violated rules instead of stopping at the first, like
constraint re-validation after a load.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialise


@dataclass(frozen=True)
class Rule:
    """A rule given by its violating rows."""
    name: str
    violations: Callable[..., DataFrame]


@dataclass(frozen=True)
class Link:
    """A foreign key: ``child.fk`` names ``parent.pk``; ``carry`` are the parent's columns that rules
    of the child, or of its own children, may look at. ``found`` is the column that is
    true where the parent exists."""
    child: str
    fk: str
    parent: str
    pk: str
    carry: tuple[str, ...] = ()

    @property
    def found(self) -> str:
        return f"_has_{self.child}_{self.fk}"


@dataclass(frozen=True)
class RowRule:
    """A rule that is a predicate over the rows of ``table``, with the parents along ``links``
    (a link of a parent after the link to that parent)."""
    name: str
    table: str
    violated: Callable[[], Column]
    links: tuple[Link, ...] = ()


def orphan(link: Link) -> RowRule:
    """Children whose non-NULL foreign key has no parent."""
    return RowRule(f"orphan:{link.child}_{link.parent}", link.child,
                   lambda: F.col(link.fk).isNotNull() & ~F.col(link.found), (link,))


def _joined(rules: list[RowRule], read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """table -> its rows with the parents its rules need; a frame that is also
    joined to another table is written, so its table is scanned once."""
    links = {link for r in rules for link in r.links}
    tables = {r.table for r in rules}
    frames: dict[str, DataFrame] = {}

    def frame(table: str) -> DataFrame:
        if table not in frames:
            df = read(table)
            up = [link for link in sorted(links, key=lambda x: (x.fk, x.parent)) if link.child == table]
            for link in up:
                above = [x for x in links if x.child == link.parent]
                further = [c for x in above for c in (*x.carry, x.found)]
                parent = frame(link.parent).select(F.col(link.pk).alias("_pk"), *link.carry, *further,
                                                   F.lit(True).alias(link.found))
                df = (df.join(parent, F.col(link.fk) == F.col("_pk"), "left").drop("_pk")
                      .withColumn(link.found, F.coalesce(link.found, F.lit(False))))
            if table in tables and any(link.parent == table for link in links):
                df = materialise(_narrow(df, table, rules, links))
            frames[table] = df
        return frames[table]

    return {t: frame(t) for t in sorted(tables)}


def _narrow(df: DataFrame, table: str, rules: list[RowRule], links: set[Link]) -> DataFrame:
    """What others read of a written frame: keys, carried columns, and one flag a rule."""
    mine = [r.violated().alias(f"_v:{r.name}") for r in rules if r.table == table]
    keys = {link.pk for link in links if link.parent == table} | {c for link in links if link.parent == table for c in link.carry}
    up = {c for link in links if link.child == table for c in (*link.carry, link.found)}
    return df.select(*sorted((keys | up) & set(df.columns)), *mine)


def counts(rules: Iterable[Rule | RowRule], read: Callable[[str], DataFrame]) -> DataFrame:
    """(rule, violations) for every rule, violated or not; ``read`` gives a table by its name."""
    rules = list(rules)
    parts = [r.violations(read).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(r.name).alias("rule"), "violations")
             for r in rules if isinstance(r, Rule)]
    of_rows = [r for r in rules if isinstance(r, RowRule)]
    for table, frame in _joined(of_rows, read).items():
        group = [r for r in of_rows if r.table == table]
        flags = [F.col(f"`_v:{r.name}`") if f"_v:{r.name}" in frame.columns else r.violated() for r in group]
        row = frame.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(f"v{i}") for i, v in enumerate(flags)])
        parts.append(row.select(F.explode(F.array(*[
            F.struct(F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("violations"))
            for i, r in enumerate(group)])).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def report(rules: Iterable[Rule | RowRule], read: Callable[[str], DataFrame]) -> DataFrame:
    """Only the violated rules."""
    return counts(rules, read).filter("violations > 0")


def check_fails(pred: Column) -> Column:
    """CHECK semantics: a row violates only when the predicate is FALSE (NULL passes)."""
    return ~F.coalesce(pred, F.lit(True))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their multiplicity (partial-aggregated)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_counts(df: DataFrame, prefix: str = "notnull:") -> DataFrame:
    """(rule, violations) per column in one pass: sum of isNull flags."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("rule"), F.col(c).alias("violations"))
                                          for c in df.columns])).alias("r")).select("r.*")
