"""Small helpers the operators share: word splitting, hashing, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The Unicode White_Space characters, as the body of a regular-expression class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_MASK = (1 << 64) - 1


def ascii_lower(text):
    """Lower-case A-Z only (``lower`` would touch every cased letter)."""
    return F.translate(text, UPPER, UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows in an Arrow batch at most: whole texts go through them, on both sides of the pipe.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with other columns dropped, so no extra column can clash;
    null text becomes empty."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Returns the worker's free memory to the system (glibc keeps it otherwise; a worker lives on)."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):      # another C library
        pass


_forget: list[Callable[[], None]] = []


def only_cache(forget: Callable[[], None]) -> None:
    """A worker lives on from operator to operator, but keeps the caches of one: those of another, which ``forget``
    empties, go when this one's are used."""
    if _forget != [forget]:
        for other in _forget:
            other()
        _forget[:] = [forget]
        give_back()


def end_task() -> None:
    """At the end of a task its caches go too: Spark deals tasks to its waiting workers in turn, and those that wait would
    hold theirs beside the workers that run."""
    for forget in _forget:
        forget()
    _forget.clear()
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix constants), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def order_names(names: np.ndarray) -> np.ndarray:
    """An argsort of names: their leading bits and places are sorted as one number; should names differ
    in the last bits only, they are sorted as they are."""
    bits = np.uint64(len(names).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    found = names[order]
    return order if not (found[1:] < found[:-1]).any() else np.argsort(names)


def unique_of(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values, which of them each one is) of values and their argsort."""
    found = values[order]
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    which = np.empty(len(found), np.int64)
    which[order] = np.cumsum(new) - 1
    return found[new], which


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\f", np.uint8))
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Runs:
    """Runs of bytes: ``start`` and ``length`` of each in ``data``, which goes on for eight bytes after the last."""

    def __init__(self, data, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self._eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))     # eight bytes from each place on

    def same(self, mine: np.ndarray, other: Runs, theirs: np.ndarray) -> np.ndarray:
        """Whether each run of ``mine`` equals the run of ``other`` at its place in ``theirs``."""
        same = self.length[mine] == other.length[theirs]
        at, step = np.flatnonzero(same), 0
        while len(at):
            left = self.length[mine[at]] - step
            one, two = self._eight[self.start[mine[at]] + step], other._eight[other.start[theirs[at]] + step]
            equal = (one ^ two) & _FIRST_BYTES[np.minimum(left, 8)] == 0
            same[at[~equal]] = False
            at, step = at[equal & (left > 8)], step + 8
        return same


class Words(Runs):
    """The runs without ASCII white space of some texts, and how many each text has."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b" ".join([*texts, b" " * 8])
        data = data.lower() if lower else data
        space = _SPACE[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        super().__init__(data, edges[::2], edges[1::2] - edges[::2])
        self.per_text = np.diff(np.searchsorted(self.start, np.cumsum([0] + [len(t) + 1 for t in texts])))

    def _steps(self):
        """(words of more than so many bytes, and that number, and their next eight bytes)."""
        at, left = np.arange(len(self.start)), self.length
        for step in range(0, int(self.length.max(initial=0)), 8):
            if step:
                more = left > 8
                at, left = at[more], left[more] - 8
            yield at, step, self._eight[self.start[at] + step] & _FIRST_BYTES[np.minimum(left, 8)]

    def names(self) -> np.ndarray:
        """64-bit hashes of all words at once: of the length, and of eight bytes a step."""
        names = mix64(self.length.astype(np.uint64) * _LENGTH)
        for at, _, eight in self._steps():
            names[at] = mix64(names[at] ^ eight)
        return names

    def equal(self, other: np.ndarray) -> bool:
        """Whether each word is equal to the word of the number given for it."""
        if (self.length != self.length[other]).any():
            return False
        return all((eight == (self._eight[self.start[other[at]] + step] & _FIRST_BYTES[np.minimum(self.length[at] - step, 8)])).all()
                   for at, step, eight in self._steps())

    def with_ends(self, values: np.ndarray, end) -> np.ndarray:
        """The words' values text by text, each followed by ``end``."""
        out = np.full(len(values) + len(self.per_text), end, values.dtype)
        out[np.arange(len(values)) + np.repeat(np.arange(len(self.per_text)), self.per_text)] = values
        return out


class WordHashes(dict):
    """word bytes -> unsigned 64-bit hash; forgets everything when it holds
    ``limit`` words, so a task's memory stays bounded."""

    def __init__(self, limit: int = 1 << 17):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        only_cache(self.clear)
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: The worker's one cache of word hashes; operators that run in turn share it.
WORDS = WordHashes()

_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = words[:n].copy()
    for k in range(1, size):
        acc = mix64(acc) + words[k:k + n] * _BASE
    return mix64(acc)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle; no words, none."""
    if len(words) == 0:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, size))


#: Rows of two longs that are broadcast at most: some 100 MB as a hashed relation.
BROADCAST_ROWS = 1 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written, narrow table) hinted for broadcast if it has at most
    ``rows`` rows; else unhinted, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
