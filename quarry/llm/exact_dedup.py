"""Exact de-duplication by two-pass Bloom filtering (DataFrame functions only).

Pass 1 reduces every text to two filter positions and counts the positions;
those hit more than once make two bitmaps (4 KB rows per 32768 positions).
Pass 2 tests each row against the bitmaps: a text whose two positions were
not both hit repeatedly is certainly unique and passes straight through,
without a shuffle. Only the possibly repeated rows are grouped, by the
SHA-256 of their text, so a false positive costs a shuffled row and never a
wrong result.

Size bound of the broadcast: ``filter_bits`` positions per hash, sixteen a
row rounded up to a power of two, never more than ``MAX_FILTER_BITS``, hence
at most 2 * 2**29 / 8 bytes = 128 MB. Beyond 33 million rows the filter
only gets fuller: more rows take the exact path, the result is the same.

Defined results: null text counts as empty; empty texts are equal to each
other; a null id ranks below every other id; of rows equal in text and id
exactly one is kept; other columns are ignored by the comparison; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower
from quarry.session import materialise

MAX_FILTER_BITS = 1 << 29
BITS_PER_ROW = 16
_BITMAP = 1 << 15     # positions in one bitmap_construct_agg bitmap


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def filter_bits(rows: int) -> int:
    bits = _BITMAP
    while bits < BITS_PER_ROW * rows and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def _positions(digest: Column, bits: int) -> list[Column]:
    """Two independent positions; the second lies in [bits, 2 * bits)."""
    return [F.pmod(F.xxhash64(digest), F.lit(bits)),
            F.pmod(F.xxhash64(digest, F.lit(1)), F.lit(bits)) + F.lit(bits)]


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the positions that more than one row of ``digests`` hits."""
    pos = F.explode(F.array(*_positions(F.col("digest"), bits))).alias("pos")
    return (digests.select(pos).groupBy("pos").count().filter("count > 1")
            .groupBy(F.shiftright("pos", 15).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("pos").bitwiseAND(_BITMAP - 1)).alias("bitmap")))


def _bit(bitmap: str, pos: str) -> Column:
    """Whether the bitmap has the bit of the position (a missing bitmap has none)."""
    byte = f"conv(hex(substring({bitmap}, int(({pos} & {_BITMAP - 1}) >> 3) + 1, 1)), 16, 10)"
    return F.expr(f"coalesce((shiftright(int({byte}), int({pos} & 7)) & 1) = 1, false)")


def mark_possible_repeats(df: DataFrame, digest: str, bitmaps: DataFrame, bits: int,
                          out: str = "__maybe") -> DataFrame:
    """Adds ``out``: false only if no other row can have the same digest. No shuffle."""
    for k, pos in enumerate(_positions(F.col(digest), bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__b{k}"), F.col("bitmap").alias(f"__m{k}")))
        df = (df.withColumn(f"__p{k}", pos)
              .join(side, F.shiftright(F.col(f"__p{k}"), 15) == F.col(f"__b{k}"), "left"))
    return df.withColumn(out, _bit("__m0", "__p0") & _bit("__m1", "__p1")).drop(*[f"__{c}{k}" for c in "pbm" for k in (0, 1)])


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = materialise(df.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")))
    bits = filter_bits(narrow.count())
    marked = mark_possible_repeats(narrow, "digest", repeat_filter(narrow, bits), bits)
    alone = marked.filter("NOT __maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    # One row per (text, id): a group of copies spreads over partitions by id,
    # and the join on the text alone can be split where a group is large.
    maybe = marked.filter("__maybe").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    sizes = maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    grouped = maybe.join(sizes, "digest").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return alone.unionByName(grouped.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256")))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns unchanged. Rows alone in their group are
    never shuffled; a possibly repeated row is, once."""
    cols = df.columns
    hashed = df.withColumn("__digest", text_digest(F.col(text_col)))
    narrow = materialise(hashed.select(F.col("__digest").alias("digest")))
    bits = filter_bits(narrow.count())
    marked = mark_possible_repeats(hashed, "__digest", materialise(repeat_filter(narrow, bits)), bits)
    # The join's key holds the id, so the rows of one large group do not meet in one task.
    alone = marked.filter("NOT __maybe").select(*cols)
    maybe = marked.filter("__maybe").drop("__maybe")
    best = maybe.groupBy("__digest").agg(F.max(id_col).alias("__keep"))
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy("__digest").orderBy(F.xxhash64(*plain))
    kept = (maybe.join(best.withColumnRenamed("__digest", "__key"),
                       (F.col("__digest") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__keep")))
            .withColumn("__rank", F.row_number().over(order)).filter("__rank = 1"))
    return alone.unionByName(kept.select(*cols))
