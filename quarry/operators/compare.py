"""Result-set comparison as distributed jobs.

Semantics (fixed by the benchmark being rebuilt):

* cells: NULL stays NULL; booleans and all numbers compare as numbers, whole
  ones exactly and others rounded to 6 places (so true == 1 == 1.0, and
  2^53 != 2^53 + 1); dates/timestamps as ISO text; arrays/maps/structs by
  their JSON text; everything else as text. Text never equals a number. NaN
  never matches anything, itself included.
* ``result_eq``: prediction missing -> False; both empty -> True; one empty
  -> False; arities differ -> False; otherwise True if some permutation of
  the prediction's columns makes the two bags (or sequences, when ordered)
  equal, at any width. ``permute_up_to`` limits the permutations to results of so many
  columns, wider ones then match by position only (off by default).
* ``soft_f1``: 2|G n P| / (|G| + |P|) over bags, best permutation; 1 when
  both are empty; 0 when one is empty, missing, or of another arity.

Rows are never joined into text: bags group by the cells themselves.

Results are compared by key: a frame of results holds the rows of any number
of questions (``keyed``: qid, cells, pos), and all questions are judged
together in a fixed number of jobs (``common_rows``). What a pair of results
has in common under a column map f is I(f) = sum over rows of the smaller
multiplicity; equality asks for a map with I = |G| = |P|, inclusion for one
with I = |G|, soft-F1 for the largest I. The steps:

For equality most is settled without writing rows at all: one pass over both sides counts
rows and marks columns (``_prints``), which leaves only questions with as many rows and a column
map by those marks; the rows of a question with one such map are read once more and
added up side by side, which is one shuffle (``_count_once``). The results must then give the same
rows when read again, as for any lost task. Questions with more maps, and other modes, go on so:

1. both sides' bags are written; a row's ``spot`` is the partition it was written in, and
   whatever belongs to a question is joined to its rows by question and spot, so one
   question's rows never meet in one task;
2. per question, every pair of columns gets an upper bound on I: for equality
   from per-column fingerprints (one pass without a shuffle of cells), else
   the exact intersection of the two columns' bags;
3. a group function per question lists maps in falling order of the smallest
   bound of their pairs; columns that are equal in every row are taken in
   order only, so they never multiply the maps;
4. the first ``FIRST`` maps of each question are counted exactly in one job;
5. only questions whose best count may still be beaten go on: all maps that
   may beat it are counted in one more job if they are at most ``MANY``; else
   maps grow column by column, one job a level, and a map goes when what its
   columns have in common cannot beat the best.

Nothing about rows reaches the driver, only how many questions go on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import materialise

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _plain(text: Column) -> Column:
    """A decimal's text without trailing zeros, so equal numbers of any type are equal text."""
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def _number(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, _WHOLE):
        return c.cast("long").cast("string")
    if isinstance(dt, T.DecimalType):
        return _plain(F.round(c, 6).cast("string")) if dt.scale else c.cast("string")
    d = c.cast("double")
    # Below 10^18 a double's rounded value has an exact decimal form; beyond,
    # it is whole anyway and its shortest text names it.
    return F.when(F.abs(d) < 1e18, _plain(F.round(d, 6).cast("decimal(38,6)").cast("string"))) \
        .otherwise(F.coalesce(_plain(d.cast("decimal(38,0)").cast("string")), d.cast("string")))


def _cell(field: T.StructField, nan_salt: Column | None = None) -> Column:
    c = F.col(f"`{field.name}`")
    dt = field.dataType
    if isinstance(dt, (*_WHOLE, *_FRACTIONAL)):
        num = F.concat(F.lit("n:"), _number(c, dt))
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            salt = nan_salt if nan_salt is not None else F.expr("uuid()")
            num = F.when(F.isnan(c), F.concat(F.lit("nan:"), salt.cast("string"))).otherwise(num)
        return num
    if isinstance(dt, T.DateType):
        return F.concat(F.lit("s:"), F.date_format(c, "yyyy-MM-dd"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit("s:"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.concat(F.lit("j:"), F.to_json(c))
    if isinstance(dt, T.BinaryType):
        return F.concat(F.lit("b:"), F.hex(c))
    return F.concat(F.lit("s:"), c.cast("string"))


def normalise(df: DataFrame, side: str = "", pos: str | None = None) -> DataFrame:
    """C-NORM: every column -> tagged text cell (``c0..cN``), NULL kept; a ``pos``
    column is carried as it is. ``side`` tags NaN cells so that two sides
    never share a NaN token."""
    salt = F.concat(F.lit(side), F.monotonically_increasing_id().cast("string"))
    fields = [f for f in df.schema.fields if f.name != pos]
    return df.select(*[_cell(f, salt).alias(f"c{i}") for i, f in enumerate(fields)],
                     *([F.col(pos).alias("pos")] if pos else []))


def _cells(df_norm: DataFrame) -> list[str]:
    return [c for c in df_norm.columns if c != "pos"]


def ordered_by_text(sql: Column) -> Column:
    """Fallback order rule when no parse tree is available: the query text
    contains ORDER BY (any case, any whitespace between the words)."""
    return F.lower(sql).rlike(r"order\s+by")


def bag(df_norm: DataFrame, order: list[int] | None = None, count: str = "m") -> DataFrame:
    """Multiset of normalised rows: (r0..rN, count). ``order`` permutes the
    columns; a ``pos`` column is compared as a further cell, not permuted."""
    cells = [f"c{i}" for i in order] if order is not None else _cells(df_norm)
    keys = [F.col(c).alias(f"r{i}") for i, c in enumerate(cells)]
    if "pos" in df_norm.columns:
        keys.append(F.col("pos").cast("string").alias(f"r{len(cells)}"))
    return df_norm.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))


def _matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Two bags joined null-safely on all their cells (r0..rN)."""
    cells = [c for c in left.columns if c[0] == "r"]
    other = right.select(*[F.col(c).alias(f"o_{c}") for c in cells], *[c for c in right.columns if c not in cells])
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in cells]
    joined = left.join(other, same, how)
    found = "n_right" if "n_right" in joined.columns else None
    if how == "full" and found:      # a right-only row has its cells on the right
        joined = joined.withColumns({c: F.when(F.col("n_left").isNull(), F.col(f"o_{c}")).otherwise(F.col(c))
                                     for c in cells})
    return joined.drop(*[f"o_{c}" for c in cells])


def bag_diff(left: DataFrame, right: DataFrame, order: list[int] | None = None) -> DataFrame:
    """C-DIFF: (r0..rN, n_left, n_right, status) for every row whose multiplicity differs."""
    j = _matched(bag(left, None, "n_left"), bag(right, order, "n_right"), "full").fillna(0, ["n_left", "n_right"])
    status = (F.when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only")
              .otherwise("changed"))
    return j.filter(F.col("n_left") != F.col("n_right")).withColumn("status", status)


def bags_equal(left: DataFrame, right: DataFrame, order: list[int] | None = None) -> bool:
    return bag_diff(left, right, order).isEmpty()


# -- results of many questions ----------------------------------------------------------

#: Maps that are counted for every question; and maps that one further job counts for a question at most.
FIRST, MANY = 24, 1 << 16


def keyed(frames: dict[str, DataFrame], side: str, pos: str | None = None) -> DataFrame:
    """(qid, cells, pos) of the frames by question: normalised cells, and the position if it counts."""
    rows = None
    for qid, frame in frames.items():
        n = normalise(frame, side, pos)
        one = n.select(F.lit(qid).alias("qid"), F.array(*[F.col(c) for c in _cells(n)]).alias("cells"),
                       (F.col("pos") if pos else F.lit(None)).cast("long").alias("pos"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def keyed_rows(frame: DataFrame, results: list[tuple[Column, Column | None, list[Column]]], side: str) -> DataFrame:
    """(qid, cells, pos) of many results of one frame, in one scan of it: each result is
    (question, which rows or None for all, columns); results of one question add up."""
    flat = [c.alias(f"r{n}_{i}") for n, (_, _, columns) in enumerate(results) for i, c in enumerate(columns)]
    ids = [q.cast("string").alias(f"q{n}") for n, (q, _, _) in enumerate(results)]
    use = [(F.lit(True) if on is None else F.coalesce(on, F.lit(False))).alias(f"u{n}") for n, (_, on, _) in enumerate(results)]
    wide = frame.select(*flat, *ids, *use)
    kinds = {f.name: f for f in wide.schema.fields}
    salt = F.concat(F.lit(side), F.monotonically_increasing_id().cast("string"))
    rows = [F.when(F.col(f"u{n}"), F.struct(F.col(f"q{n}").alias("qid"),
                                            F.array(*[_cell(kinds[f"r{n}_{i}"], salt) for i in range(len(columns))]).alias("cells")))
            for n, (_, _, columns) in enumerate(results)]
    return (wide.select(F.explode(F.array_compact(F.array(*rows))).alias("e"))
            .select("e.qid", "e.cells", F.lit(None).cast("long").alias("pos")))


def _both(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(side, qid, cells, pos): both sides' rows."""
    return gold.withColumn("side", F.lit("g")).unionByName(pred.withColumn("side", F.lit("p")))


def _bags_of(both: DataFrame) -> DataFrame:
    """(side, qid, cells, pos, m, spot): the rows with their multiplicity; to be written."""
    return both.groupBy("side", "qid", "cells", "pos").agg(F.count(F.lit(1)).alias("m")).withColumn("spot", F.spark_partition_id())


def _bags(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return _bags_of(_both(gold, pred))


def _spots(bags: DataFrame) -> DataFrame:
    """(qid, spot, n_gold, n_pred, w_gold, w_pred): rows and columns of each side in each spot."""
    gold = F.col("side") == "g"
    rows = lambda on: F.coalesce(F.sum(F.when(on, F.col("m"))), F.lit(0))
    width = lambda on: F.max(F.when(on, F.size("cells")))
    return bags.groupBy("qid", "spot").agg(rows(gold).alias("n_gold"), rows(~gold).alias("n_pred"),
                                           width(gold).alias("w_gold"), width(~gold).alias("w_pred"))


def _sides(spots: DataFrame) -> DataFrame:
    """(qid, n_gold, n_pred, w_gold, w_pred): rows and columns of each side, 0 rows where there are none."""
    return spots.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("n_gold", "n_pred")], *[F.max(c).alias(c) for c in ("w_gold", "w_pred")])


def _of_questions(bags: DataFrame, spots: DataFrame, frame: DataFrame, how: str = "inner") -> DataFrame:
    """``bags`` joined to the rows of ``frame`` of the same question, spot by spot."""
    return bags.join(spots.select("qid", "spot").join(frame, "qid"), ["qid", "spot"], how)


def _prints(bags: DataFrame) -> DataFrame:
    """(qid, side, col, rows, mark, twin) per column; ``col`` is NULL for rows without columns. ``mark``: the bag of (cell, row) where a row
    is known by the bag of its cells, so a column of an equal result has the same mark
    whatever the order of columns. ``twin``: the same with the row's cells in order, so
    columns of one side with one twin mark are equal in every row."""
    cell = lambda c: F.xxhash64(F.coalesce(c, F.lit("null")))
    row = F.aggregate(F.transform("cells", cell), F.lit(0).cast("decimal(38,0)"),
                      lambda a, x: (a + x).cast("decimal(38,0)"))
    known = bags.select("qid", "side", "m", "pos", "cells", row.alias("row"))
    cells = known.select("qid", "side", "m", F.xxhash64("row", "pos").alias("bag"), F.xxhash64("cells", "pos").alias("order"),
                         F.posexplode_outer("cells").alias("col", "cell"))
    total = lambda h: F.sum(F.col("m") * h.cast("decimal(28,0)")).cast("string")
    return cells.groupBy("qid", "side", "col").agg(
        F.sum("m").alias("rows"),
        F.concat_ws(":", total(F.xxhash64("cell", "bag")), total(F.xxhash64("bag", "cell"))).alias("mark"),
        F.concat_ws(":", total(F.xxhash64("cell", "order")), total(F.xxhash64("order", "cell"))).alias("twin"))


def _overlaps(bags: DataFrame) -> DataFrame:
    """(qid, i, j, common): the bag intersection of gold column i with prediction column j."""
    cells = bags.select("qid", "side", "m", F.posexplode("cells").alias("col", "cell"))
    values = cells.groupBy("qid", "side", "col", "cell").agg(F.sum("m").alias("m"))
    g = values.filter("side = 'g'").select("qid", F.col("col").alias("i"), "cell", F.col("m").alias("mg"))
    p = values.filter("side = 'p'").select(F.col("qid").alias("q"), F.col("col").alias("j"), F.col("cell").alias("c"),
                                           F.col("m").alias("mp"))
    both = g.join(p, (F.col("qid") == F.col("q")) & F.col("cell").eqNullSafe(F.col("c")))
    return both.groupBy("qid", "i", "j").agg(F.sum(F.least("mg", "mp")).alias("common"))


def _printed_sides(prints: DataFrame) -> DataFrame:
    """As ``_sides``, from the marks of columns."""
    gold = F.col("side") == "g"
    rows = lambda on: F.coalesce(F.sum(F.when(on & (F.coalesce("col", F.lit(0)) == 0), F.col("rows"))), F.lit(0))
    width = lambda on: F.max(F.when(on, F.coalesce(F.col("col") + 1, F.lit(0))))
    return prints.groupBy("qid").agg(rows(gold).alias("n_gold"), rows(~gold).alias("n_pred"),
                                     width(gold).alias("w_gold"), width(~gold).alias("w_pred"))


def _marked_bounds(prints: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, i, j, common, twin): the pairs of columns with the same mark, for equality."""
    prints = prints.filter("col is not null").join(asked.select("qid", F.col("n_gold").alias("common")), "qid")
    gold = prints.filter("side = 'g'").select("qid", F.col("col").alias("i"), "mark", "common")
    twins = prints.filter("side = 'p'").select("qid", F.col("col").alias("j"), "mark", "twin")
    return gold.join(twins, ["qid", "mark"]).select("qid", "i", "j", "common", "twin")


def _bounds(bags: DataFrame) -> DataFrame:
    """(qid, i, j, common, twin): upper bounds per pair of columns, and the prediction column's twin mark."""
    twins = _prints(bags).filter("side = 'p'").select("qid", F.col("col").alias("j"), "twin")
    return _overlaps(bags).join(twins, ["qid", "j"])


def _choices(bounds: dict[tuple[int, int], int], twins: dict[int, str], width: int, least: int) -> Iterator[dict[int, int]]:
    """All one-to-one maps of gold columns whose pairs have a bound of ``least`` or more; the
    column with the fewest free choices is mapped next; of equal columns the first free one."""
    allowed = {i: [j for j in sorted(twins) if bounds.get((i, j), -1) >= least] for i in range(width)}

    def go(chosen: dict[int, int], used: set[int]) -> Iterator[dict[int, int]]:
        if len(chosen) == width:
            yield chosen
            return
        free = {i: [j for j in js if j not in used] for i, js in allowed.items() if i not in chosen}
        i = min(free, key=lambda x: len(free[x]))
        tried = set()
        for j in free[i]:
            if twins[j] not in tried:
                tried.add(twins[j])
                yield from go(chosen | {i: j}, used | {j})

    if _matchable(allowed):
        yield from go({}, set())


def _matchable(allowed: dict[int, list[int]]) -> bool:
    """Whether all gold columns can have a column of their own (augmenting paths)."""
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in allowed[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in allowed)


def best_first(bounds: dict[tuple[int, int], int], twins: dict[int, str], width: int, over: int) -> Iterator[list[int]]:
    """Maps by falling smallest bound, for each bound above ``over`` from the largest down."""
    for least in sorted({c for c in bounds.values() if c > over}, reverse=True):
        for chosen in _choices(bounds, twins, width, least):
            if min(bounds[pair] for pair in chosen.items()) == least:
                yield [chosen[i] for i in range(width)]


def _list_maps(most: int, best_order: bool):
    """Group function: ``most`` at most of a question's maps that may reach ``need`` and beat
    ``best``; a last row without a map says that there are more."""
    def run(pdf):
        import pandas as pd
        qid, width = pdf["qid"].iloc[0], int(pdf["w_gold"].iloc[0])
        over = max(int(pdf["best"].iloc[0]), int(pdf["need"].iloc[0]) - 1)
        bounds = {(int(i), int(j)): int(c) for i, j, c in zip(pdf["i"], pdf["j"], pdf["common"], strict=True)}
        twins = {int(j): t for j, t in zip(pdf["j"], pdf["twin"], strict=True)}
        maps = best_first(bounds, twins, width, over) if best_order else \
            ([c[i] for i in range(width)] for c in _choices(bounds, twins, width, over + 1))
        rows = [(qid, m) for m in itertools.islice(maps, most + 1)]
        if len(rows) > most:
            rows[-1] = (qid, None)
        return pd.DataFrame(rows, columns=["qid", "cols"])

    return run


def _count(bags: DataFrame, spots: DataFrame, maps: DataFrame, levels: int | None = None, all_columns: bool = False) -> DataFrame:
    """(qid, cols, common): I of each map (qid, cols); with ``levels`` of the first so many columns. A bag's
    rows are distinct, and stay so under a map of ``all_columns``; else they are added up first."""
    g = bags.filter("side = 'g'").select("qid", "pos", F.col("cells").alias("row"), F.col("m").alias("mg"))
    if levels is not None:
        g = g.groupBy("qid", F.slice("row", F.lit(1), F.lit(levels)).alias("row"), "pos").agg(F.sum("mg").alias("mg"))
    p = bags.filter("side = 'p'").select("qid", "spot", "cells", "pos", F.col("m").alias("mp"))
    mapped = _of_questions(p, spots.filter("n_pred > 0"), maps).select("qid", "cols", "pos", "mp", F.transform("cols", lambda j: F.get("cells", j)).alias("row"))
    if not all_columns:
        mapped = mapped.groupBy("qid", "cols", "row", "pos").agg(F.sum("mp").alias("mp"))
    g = g.select(F.col("qid").alias("q"), F.col("row").alias("r"), F.col("pos").alias("at"), "mg")
    same = (F.col("qid") == F.col("q")) & (F.col("row") == F.col("r")) & F.col("pos").eqNullSafe(F.col("at"))
    return mapped.join(g, same).groupBy("qid", "cols").agg(F.sum(F.least("mg", "mp")).alias("common"))


def _grow(bags: DataFrame, spots: DataFrame, state: DataFrame, bounds: DataFrame) -> DataFrame:
    """(qid, best) by growing maps column by column; ``state``: qid, w_gold, need, best."""
    widths = state.agg(F.max("w_gold")).first()[0] or 0
    pairs = bounds.join(state.select("qid", "need", "best"), "qid").filter("common >= need and common > best")
    pairs = materialise(pairs.groupBy("qid", "i").agg(F.collect_list(F.struct("j", "twin")).alias("js")))   # <= columns
    live = state.select("qid", "w_gold", "need", "best", F.array().cast("array<int>").alias("cols"))
    ended = None
    for level in range(widths):
        grown = (live.join(pairs.filter(F.col("i") == level).drop("i"), "qid")
                 .select("qid", "w_gold", "need", "best", "cols", "js", F.explode("js").alias("e"))
                 .filter(~F.array_contains("cols", F.col("e.j")))
                 # of equal columns the first that is free
                 .filter(~F.exists("js", lambda x: (x.twin == F.col("e.twin")) & (x.j < F.col("e.j"))
                                   & ~F.array_contains("cols", x.j)))
                 .withColumn("cols", F.array_append("cols", F.col("e.j"))).drop("js", "e"))
        counted = _count(bags, spots, grown.select("qid", "cols"), level + 1)
        live = materialise(grown.join(counted, ["qid", "cols"]).filter("common >= need and common > best"))
        done = live.filter(F.col("w_gold") == level + 1).select("qid", "common")
        ended = done if ended is None else ended.unionByName(done)
        live = live.filter(F.col("w_gold") > level + 1).drop("common")
    found = ended.groupBy("qid").agg(F.max("common").alias("found"))
    return state.join(found, "qid", "left").select("qid", F.greatest("best", F.coalesce("found", F.lit(-1))).alias("best"))


#: Rows of a table of questions or maps that is sent to all tasks at most; beyond, a question's rows meet its own in SALTS shares.
SENT, SALTS = 1 << 17, 16


def _with_rows(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """``rows`` joined to the rows of ``frame`` (written) of the same question, without moving rows if ``frame`` is small."""
    if frame.limit(SENT + 1).count() <= SENT:
        return rows.join(F.broadcast(frame), "qid")
    share = F.pmod(F.xxhash64("cells", "pos"), F.lit(SALTS))
    shares = frame.withColumn("share", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return rows.withColumn("share", share).join(shares, ["qid", "share"]).drop("share")


def _count_once(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """(qid, common): I of the one map (qid, cols) of each question. Rows of both sides (not bags) are added up
    together by the cells of the gold row they are or are mapped to."""
    gold = F.col("side") == "g"
    row = F.when(gold, F.col("cells")).otherwise(F.transform("cols", lambda j: F.get("cells", j)))
    both = _with_rows(rows, maps).select("qid", "pos", row.alias("row"), gold.alias("gold"))
    counts = both.groupBy("qid", "row", "pos").agg(F.count_if("gold").alias("mg"), F.count_if(~F.col("gold")).alias("mp"))
    return counts.groupBy("qid").agg(F.sum(F.least("mg", "mp")).alias("common"))


def _maps(state: DataFrame, bounds: DataFrame, most: int, best_order: bool) -> DataFrame:
    return materialise(state.join(bounds, "qid").groupBy("qid")
                       .applyInPandas(_list_maps(most, best_order), "qid string, cols array<int>"))


def _state(asked: DataFrame, need: Column) -> DataFrame:
    return asked.select("qid", "w_gold", need.cast("long").alias("need"), F.lit(-1).cast("long").alias("best"))


def _equal_rows(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``common_rows`` for equality."""
    rows = _both(gold, pred)
    prints = materialise(_prints(rows.withColumn("m", F.lit(1))))
    sides = _printed_sides(prints)
    asked = sides.filter("n_gold > 0 and n_pred > 0 and n_gold = n_pred and w_gold = w_pred")
    state, bounds = _state(asked, F.col("n_gold")), _marked_bounds(prints, asked)
    listed = _maps(state, bounds, FIRST, True)
    how_many = listed.groupBy("qid").agg(F.count(F.lit(1)).alias("maps"), F.first("cols").alias("cols"))
    best = _count_once(rows, materialise(how_many.filter("maps = 1").drop("maps")))
    several = materialise(how_many.filter("maps > 1").select("qid"))
    if not several.isEmpty():
        bags = materialise(_bags_of(_with_rows(rows, several)))
        more = _best_maps(bags, materialise(_spots(bags)), sides, state.join(several, "qid", "left_semi"), materialise(bounds),
                          listed.join(several, "qid", "left_semi"), True)
        best = best.unionByName(more.select("qid", F.col("best").alias("common")))
    return sides.join(best.filter("common >= 0"), "qid", "left")


def common_rows(gold: DataFrame, pred: DataFrame, mode: str) -> DataFrame:
    """(qid, n_gold, n_pred, w_gold, w_pred, common) of ``keyed`` results: rows and columns of
    both sides, and the most rows in common under any column map. ``mode`` is "equal",
    "inside" (gold in prediction) or "most"; in the first two maps that cannot reach
    all rows are not followed, and ``common`` is then less than all rows, or NULL.
    Questions without rows on both sides are not in the frame."""
    if mode == "equal":
        return _equal_rows(gold, pred)
    bags = materialise(_bags(gold, pred))
    spots = materialise(_spots(bags))
    sides = _sides(spots)
    fits = {"most": "w_gold = w_pred", "inside": "w_gold <= w_pred"}[mode]
    asked = sides.filter(f"n_gold > 0 and n_pred > 0 and {fits}")
    state = _state(asked, F.lit(0) if mode == "most" else F.col("n_gold"))
    bounds = materialise(_bounds(_of_questions(bags, spots, asked.select("qid"), "left_semi")))
    best = _best_maps(bags, spots, sides, state, bounds, _maps(state, bounds, FIRST, True), mode == "most")
    return sides.join(best.select("qid", F.when(F.col("best") >= 0, F.col("best")).alias("common")), "qid", "left")


def _best_maps(bags: DataFrame, spots: DataFrame, sides: DataFrame, state: DataFrame, bounds: DataFrame, listed: DataFrame,
               all_columns: bool) -> DataFrame:
    """(qid, best) of the questions of ``state``, whose first maps are ``listed``."""
    def count(state: DataFrame, listed: DataFrame) -> DataFrame:
        found = _count(bags, spots, listed.filter("cols is not null"), None, all_columns).groupBy("qid").agg(F.max("common").alias("found"))
        return materialise(state.join(found, "qid", "left")
                           .select("qid", "w_gold", "need", F.greatest("best", F.coalesce("found", F.lit(-1))).alias("best")))

    state = count(state, listed)
    more = _open(state, listed, sides)
    if not more.isEmpty():
        rest = _maps(more, bounds, MANY, False)
        endless = rest.filter("cols is null").select("qid").distinct()
        counted = count(more.join(endless, "qid", "left_anti"), rest.join(endless, "qid", "left_anti"))
        wide = more.join(endless, "qid", "left_semi")
        state = state.join(more.select("qid"), "qid", "left_anti").select("qid", "best").unionByName(counted.select("qid", "best"))
        if not wide.isEmpty():
            wide = materialise(wide)
            state = state.unionByName(_grow(_of_questions(bags, spots, wide.select("qid"), "left_semi"), spots, wide, bounds))
    return state.select("qid", "best")


def _open(state: DataFrame, listed: DataFrame, sides: DataFrame) -> DataFrame:
    """The questions that have further maps and no perfect one yet."""
    more = state.join(listed.filter("cols is null").select("qid").distinct(), "qid", "left_semi")
    full = sides.select("qid", F.least("n_gold", "n_pred").alias("full"))
    return more.join(full, "qid").filter("best < full").drop("full")


def judge(questions: DataFrame, gold: DataFrame, pred: DataFrame, mode: str = "equal") -> DataFrame:
    """(qid, n_gold, n_pred, common, verdict, soft_f1) for each question of
    ``questions`` (qid, answered): C-EX and C-ORDERED (rows of ``keyed`` with positions)
    for mode "equal", C-SUBSET for "inside", C-SOFTF1 for "most"; ``verdict`` of "most" is
    equality, and ``soft_f1`` is NULL in the other modes."""
    found = common_rows(gold, pred, mode)
    q = questions.select("qid", F.coalesce("answered", F.lit(False)).alias("answered")).join(found, "qid", "left")
    n_gold, n_pred = F.coalesce("n_gold", F.lit(0)), F.coalesce("n_pred", F.lit(0))
    common = F.coalesce("common", F.lit(0))
    same = (n_gold == n_pred) & (common == n_gold) if mode != "inside" else common == n_gold
    soft = F.when(~F.col("answered"), 0.0).when(n_gold + n_pred == 0, 1.0).otherwise(2.0 * common / (n_gold + n_pred))
    return q.select("qid", n_gold.alias("n_gold"), n_pred.alias("n_pred"), common.alias("common"),
                    (F.col("answered") & same).alias("verdict"),
                    (soft if mode == "most" else F.lit(None).cast("double")).alias("soft_f1"))


# -- one pair of results ----------------------------------------------------------------

def _one(gold: DataFrame, pred: DataFrame, mode: str, pos: str | None = None) -> DataFrame:
    questions = gold.sparkSession.createDataFrame([("q", True)], "qid string, answered boolean")
    return judge(questions, keyed({"q": gold}, "g", pos), keyed({"q": pred}, "p", pos), mode)


def result_eq(gold: DataFrame, pred: DataFrame | None, order_matters: bool = False,
              pos: str | None = None, permute_up_to: int | None = None) -> bool:
    """C-EX / C-ORDERED of one pair. When ordered, both frames carry a ``pos`` column
    (position after the query's sort); it is compared, not permuted."""
    if pred is None:
        return False
    if pos and not order_matters:
        gold, pred = gold.drop(pos), pred.drop(pos)
    pos = pos if order_matters else None
    width = len(gold.columns) - bool(pos)
    if permute_up_to is not None and width > permute_up_to and len(pred.columns) == len(gold.columns):
        return bags_equal(normalise(gold, "g", pos), normalise(pred, "p", pos))
    return _one(gold, pred, "equal", pos).first()["verdict"]


def soft_f1(gold: DataFrame, pred: DataFrame | None) -> float:
    """C-SOFTF1 of one pair."""
    return 0.0 if pred is None else _one(gold, pred, "most").first()["soft_f1"]


def contains(gold: DataFrame, pred: DataFrame) -> bool:
    """C-SUBSET (lenient) of one pair: every gold row is in the prediction once gold's
    columns are matched, by value, to some prediction columns (names and
    order ignored; extra prediction columns allowed), at any width."""
    return _one(gold, pred, "inside").first()["verdict"]
