"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped by form.

Words are counted once per task (bounded tables of partial counts) and once
over all. A word's letters with their repetitions are a binary vector: one
dimension for each (letter, which occurrence of it). One inserted or deleted
letter changes one dimension, one replaced letter two, so near words have
vectors with a Hamming distance of at most two.

PartEnum with one first-level part and ``PARTS`` second-level parts: the
dimensions are dealt to the parts, and for every choice of two parts the
other parts' content is an exact signature. Two vectors at distance two or
less differ in at most two parts, so they agree on the signature that leaves
these out. Words of one vector (anagrams) are never near each other and
travel together, at most ``CHUNK`` to a row. Signature rows equi-join with
themselves (one exchange, used on both sides); a pair of vectors is looked at
under one of its signatures only; words of the pair are verified by their
exact edit distance.

A length takes part in the signature through two overlapping grids of
neighbouring lengths, (2i, 2i + 1) and (2i - 1, 2i): lengths that differ by
one meet in one grid, equal lengths in the first.

Bounds: the count tables of a task hold ``TABLE`` words; the letters' order,
sent to the tasks, has a row per letter of the alphabet (90 at most); a
signature row holds ``CHUNK`` words. Distances are computed in a band around
the diagonal, so long words cost their length. A form's count is at least
twice its word's, so chains of forms are short (the logarithm of the largest
count) and roots are found by doubling steps.

Contents of parts and signatures are 64-bit hashes: a pair is lost only if
two different contents have equal hashes in every part in which they differ.

Defined results: null or empty text has no words; a null id counts as an
empty string before the colon; equal rows and repeated ids count each time;
no words, no result rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import UPPER, mix64, text_rows
from quarry.session import materialise

#: Second-level parts of the dimensions; two of them are left out of each signature.
PARTS = 6
#: Words of a task's count table before it is sent on.
TABLE = 1 << 19
#: Words of equal letters in one signature row.
CHUNK = 32

LETTERS = "A-Za-zÀ-ÿ"
_MASK = (1 << 64) - 1


# -- counts -----------------------------------------------------------------------------

def misspell(word: str, seed: int, every: int) -> str:
    """The run without one of its letters, for one in ``every`` seeds."""
    if seed % every:
        return word
    at = seed % len(word)
    return word[:at] + word[at + 1:]


def _count(least: int, every: int | None):
    lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
    runs = re.compile(f"[{LETTERS}]{{{max(least, 1)},}}").findall    # a run only gets shorter

    def batch_of(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())],
                                          ["word", "n"])

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                docs = part.column("doc_id").to_pylist()
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for doc, text in zip(docs, texts, strict=True):
                    start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                    for word, n in Counter(runs(text.translate(lower).decode())).items():
                        if every:
                            word = misspell(word, zlib.crc32(word.encode(), start), every)
                            if len(word) < least:
                                continue
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= TABLE:
                    yield batch_of(counts)
                    counts = {}
        if counts:
            yield batch_of(counts)

    return run


def word_counts(df: DataFrame, least_length: int = 5, least_count: int = 3, every: int | None = 97,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal letter runs of the texts, A-Z lower-cased, of at least
    ``least_length`` letters and ``least_count`` occurrences. ``every``: the
    share of (document, run) pairs that lose a letter is one in so many; None: no loss."""
    partial = text_rows(df, id_col, text_col).mapInArrow(_count(least_length, every), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# -- signatures -------------------------------------------------------------------------

def letter_order(words: DataFrame) -> str:
    """The letters of the words, the most frequent first (a row per letter of the alphabet)."""
    found = (words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter != ''")
             .groupBy("letter").count().collect())
    return "".join(r.letter for r in sorted(found, key=lambda r: (-r["count"], r.letter)))


def part_hashes(bag: str, order: dict[str, int], parts: int = PARTS) -> list[int]:
    """One 64-bit hash of each part's content, for the letters of a word in
    sorted order. Frequent letters are dealt to the parts in turn, there and
    back; further occurrences of a letter go to the parts that follow."""
    sums = [0] * parts
    before, nth = "", 0
    for letter in bag:
        nth = nth + 1 if letter == before else 0
        before = letter
        rank = order.get(letter, len(order))
        lap, at = divmod(rank, parts)
        part = (at if lap % 2 == 0 else parts - 1 - at) + nth
        mixed = (ord(letter) << 32 | nth + 1) * 0x9E3779B97F4A7C15 & _MASK
        mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & _MASK
        sums[part % parts] += mixed ^ mixed >> 32
    return [s & _MASK for s in sums]


_ROWS = pa.schema([("sig", pa.int64()), ("first", pa.int8()), ("x", pa.int64()), ("y", pa.int64()),
                   ("bag", pa.string()), ("grid", pa.int8()), ("words", pa.list_(pa.string()))])
_ROWS_DDL = "sig long, first byte, x long, y long, bag string, grid byte, words array<string>"


def _signatures(order: str, parts: int):
    rank = {letter: n for n, letter in enumerate(order)}
    pairs = list(itertools.combinations(range(parts), 2))
    # 0: parts 0 and 1 are left out; 1: part 0 and another; 2: two others
    first = np.array([0 if p == (0, 1) else 1 if p[0] == 0 else 2 for p in pairs], np.int8)
    left = np.array(pairs).T
    salt = mix64(np.arange(1, 2 * len(pairs) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def rows(held: list[tuple[str, list[str]]]) -> pa.RecordBatch:
        content = mix64(np.array([part_hashes(bag, rank, parts) for bag, _ in held], np.uint64)
                        + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        x, y = content[:, left[0]], content[:, left[1]]
        sig = content.sum(axis=1, dtype=np.uint64)[:, None] - x - y
        size = np.array([len(bag) for bag, _ in held], np.uint64)[:, None]
        grids = [mix64(mix64(sig + salt[None, g * len(pairs):(g + 1) * len(pairs)]) + (size + np.uint64(g)) // np.uint64(2))
                 for g in (0, 1)]
        n, k = len(held), len(pairs)
        each = np.repeat(np.arange(n), k)
        bags, words = pa.array([b for b, _ in held], pa.string()), pa.array([w for _, w in held], pa.list_(pa.string()))
        take = pa.array(np.concatenate([each, each]))
        flat = lambda a: pa.array(np.concatenate([a.ravel(), a.ravel()]).astype(np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([g.ravel() for g in grids]).view(np.int64)), pa.array(np.tile(first, 2 * n)),
             flat(x), flat(y), bags.take(take), pa.array(np.repeat(np.array([0, 1], np.int8), n * k)), words.take(take)],
            schema=_ROWS)

    def run(batches):
        held: list[tuple[str, list[str]]] = []
        for batch in batches:
            for bag, word in zip(batch.column("bag").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if held and held[-1][0] == bag and len(held[-1][1]) < CHUNK:
                    held[-1][1].append(word)
                    continue
                if len(held) >= 128:
                    yield rows(held)
                    held = []
                held.append((bag, [word]))
        if held:
            yield rows(held)

    return run


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """The signature rows of (word): sig; x, y the content of the two parts left
    out; first, which parts these are; grid of lengths; the letters and the words."""
    bags = words.select(F.array_join(F.array_sort(F.split("word", "")), "").alias("bag"), "word")
    return (bags.repartition("bag").sortWithinPartitions("bag")
            .mapInArrow(_signatures(letter_order(words), parts), _ROWS_DDL))


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b): every pair of words one edit apart, once, in no order; ``words`` are distinct."""
    rows = signatures(words, parts)
    a, b = rows.alias("a"), rows.alias("b")
    differ_x, differ_y = F.col("a.x") != F.col("b.x"), F.col("a.y") != F.col("b.y")
    first = F.col("a.first")
    once = (differ_x & differ_y) | ((first <= 1) & ~differ_x & differ_y) | ((first == 0) & differ_x & ~differ_y)
    la, lb = F.char_length("a.bag"), F.char_length("b.bag")
    # Equal lengths: grid 0, each pair of vectors once; else the shorter one is a.
    sizes = ((la == lb) & (F.col("a.grid") == 0) & (F.col("a.bag") < F.col("b.bag"))) | (la + 1 == lb)
    close = F.levenshtein("a.bag", "b.bag", 2) >= 0
    vectors = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.grid") == F.col("b.grid"))
                     & (first == F.col("b.first")) & sizes & once & close)
    pairs = (vectors.select(F.explode("a.words").alias("a"), F.col("b.words").alias("bs"))
             .select("a", F.explode("bs").alias("b")))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1)


# -- forms ------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, in doubling steps.
    Forms must not run in circles. Words without a form are not in ``forms``."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return now


def forms(words: DataFrame, times: int = 2, parts: int = PARTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n), a written table."""
    pairs = near_pairs(words.select("word"), parts)
    links = materialise(pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("l")).select("l.*"))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (links.join(known, "near").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    found = words.join(best, "word", "left")
    enough = F.col("near_n") >= times * F.col("n")
    found = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(enough, F.col("near")).alias("form"),
                                     F.when(enough, F.col("near_n")).alias("form_n")))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                   "n", "n_near", "form_n")


def variants(df: DataFrame, least_length: int = 5, least_count: int = 3, every: int | None = 97,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of the texts with their forms and roots."""
    return forms(materialise(word_counts(df, least_length, least_count, every, id_col, text_col)))
