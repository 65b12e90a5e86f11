"""Scalar column helpers shared by the plans.

They settle, once, the spots where Spark and a SQL oracle would otherwise
disagree: month truncation on TIMESTAMP_NTZ, integer result types, exact
percentage rounding, and money arithmetic done in decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "month_ntz", "money", "epoch_micros", "iso_date", "iso_ts", "base26", "pad_key", "slug",
    "hash_uniform", "hash_int",
]


def month_ntz(ts: Column | str) -> Column:
    """First instant of the month of a TIMESTAMP_NTZ, still TIMESTAMP_NTZ.

    Goes through DATE so the result never depends on the session time zone
    (``date_trunc`` on an NTZ value returns a zoned TIMESTAMP).
    """
    return F.trunc(F.to_date(ts), "MM").cast("timestamp_ntz")


def money(c: Column | str, scale: int = 2, precision: int = 18) -> Column:
    """Money as an exact decimal; sums and products are then order-independent."""
    return F.col(c).cast(f"decimal({precision},{scale})") if isinstance(c, str) \
        else c.cast(f"decimal({precision},{scale})")


def epoch_micros(col: str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (NTZ) timestamp, with no
    time-zone conversion."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def iso_date(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_ts(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


#: Letters of the largest 64-bit number in base 26.
MAX_LETTERS = 14


def base26(n: Column, width: int = 3) -> Column:
    """Non-negative integer -> A..Z code of at least ``width`` letters, most
    significant first; larger numbers get as many letters as they need, so
    the code is one-to-one. Integer division throughout."""
    n = n.cast("long")
    letters = []
    for i in range(MAX_LETTERS - 1, -1, -1):
        power = F.lit(26 ** i).cast("long")
        letter = F.chr(F.pmod(F.call_function("div", n, power), F.lit(26)) + 65) if i else F.chr(F.pmod(n, F.lit(26)) + 65)
        letters.append(letter if i < width else F.when(n >= power, letter).otherwise(F.lit("")))
    return F.concat(*letters)


def pad_key(key: Column, width: int = 6) -> Column:
    """The key as text, zero-filled to ``width`` digits; longer keys are kept whole
    (``lpad`` would cut them)."""
    text = key.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def slug(text: Column, key: Column | None = None) -> Column:
    """Lower-case, runs of non-alphanumerics -> '-', trimmed of '-'; salted with ``key``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s if key is None else F.concat(s, F.lit("-"), key.cast("string"))


#: Hex digits of the md5 that a draw uses: 60 bits, the most a long holds as whole digits.
HASH_DIGITS = 15
HASH_RANGE = float(1 << 60)


def hash_int(stream: str, seed: int, key: Column) -> Column:
    """Deterministic 60-bit integer from (stream, seed, key) via md5.

    Independent of partitioning and row order, unlike ``rand()``; the same
    md5 spelling is available in DuckDB, so results can be checked there.
    """
    h = F.md5(F.concat(F.lit(f"{stream}|{seed}|"), key.cast("string")))
    return F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("long")


def hash_uniform(stream: str, seed: int, key: Column) -> Column:
    """Uniform double in [0, 1) from (stream, seed, key)."""
    return hash_int(stream, seed, key) / F.lit(HASH_RANGE)
