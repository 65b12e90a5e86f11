"""Spelling variants, certified packing and ranked search against brute force."""

from __future__ import annotations

import collections
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from quarry.llm import best_fit, ranked_search, variants
from quarry.llm.queries import QUERIES

LONG = "word%d " * 2000 % tuple(range(2000)) + "x" * 5000
ROWS = [(1, "Letter letter Lettre lettres LETTERS letters lettera"), (2, None), (3, ""), (4, " 12 \n--"), (None, "letter lettre Èlève élève"),
        (5, "letter letters lettres Èlève eleve"), (5, "letter letters lettres Èlève eleve"), (6, LONG), (7, LONG + " letter"),
        (8, "letters <|endoftext|> don't  　漢字 \x1c naïve×mix÷word"), (9, "letter " * 40)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank, long and repeated rows, with extra columns of clashing names."""
    rows = [(*r, "w", i, 0.5, b"p") for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int, score double, payload binary").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


# -- 11: spelling variants --------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_counts(rows, every=97):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_forms(counts):
    out = set()
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


@pytest.mark.parametrize("every", [97, 3])
def test_variants_awkward(awkward, empty, every):
    got = variants.variants(awkward, every=every).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_forms(brute_counts(ROWS, every))
    assert variants.variants(empty).collect() == []


@pytest.mark.parametrize("parts", [4, 6, 7])
def test_near_pairs_equal_brute_force(spark, parts):
    """Words of few letters, so anagrams, repeated letters and full signature groups abound."""
    rng = np.random.default_rng(parts)
    words = {"".join(rng.choice(list("abcé"), int(rng.integers(5, 9)))) for _ in range(900)}
    words |= {"z" * n for n in range(5, 12)} | {"y" * 3000, "y" * 2999 + "x", "y" * 2999}
    rows = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    got = variants.near_pairs(rows, parts).collect()
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(r) for r in got} == want


def test_more_words_of_the_same_letters_than_a_row_holds(spark):
    import itertools
    words = ["".join(p) for p in itertools.permutations("abcdef")][:200]
    words += [w + "q" for w in words[:50]] + ["q" + w[1:] for w in words[:50]]
    rows = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    got = {frozenset(r) for r in variants.near_pairs(rows).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_chains_of_forms(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)] + [("alone", "w037")]
    got = dict(variants.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w037" for w, _ in chain}


# -- 12: certified packing --------------------------------------------------------------

def fewest_bins(lengths, limit):
    """The exact number of bins, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in {b: n for n, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= limit:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_bound_is_below_the_optimum():
    rng = np.random.default_rng(0)
    certified = 0
    for _ in range(300):
        limit = int(rng.integers(5, 60))
        x = rng.integers(1, limit + 1, int(rng.integers(1, 9)))
        bins, places = best_fit.best_fit_decreasing(x, limit)
        for b in set(bins.tolist()):
            mine = np.flatnonzero(bins == b)
            mine = mine[np.argsort(places[mine])]
            assert places[mine].tolist() == [0, *np.cumsum(x[mine])[:-1]] and x[mine].sum() <= limit
        bound, fewest, got = best_fit.lower_bound(x, limit), fewest_bins(x.tolist(), limit), bins.max() + 1
        assert bound <= fewest <= got
        certified += bound == got
    assert certified > 250
    assert best_fit.lower_bound(np.array([6, 6, 6, 4, 4, 4, 4]), 10) == 4      # three and a half by length
    assert best_fit.lower_bound(np.array([], int), 10) == 0


def check_packing(pieces, rows, limit, end_id, path):
    """Every id in one piece, sequences without gaps, and all pieces as the library's ids say."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    want = collections.Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        head = len(ids) % limit
        cuts = [0] * (head > 0) + list(range(head, len(ids), limit))
        for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want[doc, n, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert collections.Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), -(-sum(n for *_, n, _ in want.elements()) // limit)


def test_packing_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_certified_packing"](spark, sf_dir).collect()
    used, least = check_packing(got, rows, 1024, 2, public_tokenizers.path("byte_bpe_50k.json"))
    assert used <= 1.005 * least + 1


@pytest.mark.parametrize("group", [best_fit.GROUP, 6])
def test_packing_awkward(awkward, empty, monkeypatch, group):
    """Special strings, odd white space, texts longer than a sequence; and groups of six pieces, so
    that documents are exchanged between groups in several rounds."""
    monkeypatch.setattr(best_fit, "GROUP", group)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for limit in (64, 9, 1):
        rows = best_fit.packed(awkward, path, limit=limit)
        check_packing(best_fit.pieces(rows).collect(), ROWS, limit, 2, path)
        for c in best_fit.certificates(rows).collect():
            assert c["bound"] <= c["bins"] <= c["pieces"]
    assert best_fit.pack(empty, path).collect() == []


def test_units_equal_the_library():
    """Ids of odd texts unit by unit: letters of many scripts, marks, digits, special strings, white space."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    units, split = best_fit.unit_ids(path), best_fit.splitter(best_fit.specials(path))
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    bits = ["a", "Zeit", "é", "ß", "ɐ", "ƻ", "×", "漢", "ا", "9", "½", "²", ".", "!", "'s", "'", "--", " ", "  ", "\n", "\t", "　",
            " ", "\x1c", "\x00", "<|endoftext|>", "<|", "😀", "́", "_", "#", "ª", "ЖЖ"]
    for _ in range(3000):
        text = "".join(rng.choice(bits, int(rng.integers(1, 9))))
        ids = np.frombuffer(b"".join(units[u] for u in split(text)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


# -- 13: ranked search ------------------------------------------------------------------

def words_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute_search(items, docs, k=10):
    """(item, rank, document, score) by the definition, in whole numbers."""
    tfs = [(d, collections.Counter(words_of(t))) for d, t in docs]
    tfs = [(d, c) for d, c in tfs if c]
    n_docs, total = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = collections.Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in tfs:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(words_of(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, n + 1, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


ITEMS = [(1, "LETTER, lettre"), (2, None), (3, ""), (4, "nowhere_to be-found"), (None, "letters"), (5, "letter"), (5, "letter"),
         (6, LONG), (7, "word1 word2 漢字 élève Èlève")]


@pytest.mark.parametrize("limits", [{}, {"TILE_ITEMS": 1, "BLOCK_BYTES": 300}])
def test_search_awkward(spark, awkward, empty, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked_search, name, value)
    items = spark.createDataFrame([(*i, "t", 3) for i in ITEMS], "item_id long, text string, term string, rank int").repartition(2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(map(tuple, ranked_search.search(items, awkward, 4).collect()), key=key)
    assert got == sorted(brute_search(ITEMS, ROWS, 4), key=key)
    assert ranked_search.search(items, empty).collect() == []
    assert ranked_search.search(items.limit(0), awkward).collect() == []


def test_search_ties_across_tiles(spark):
    """Thousands of equal documents over many partitions: the smallest ids win."""
    docs = [(i, "same words here") for i in range(5000, 0, -1)] + [(9000 + i, "other text") for i in range(50)]
    got = ranked_search.search(spark.createDataFrame([(1, "words")], "item_id long, text string"),
                               spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 10).collect()
    assert got == [] or sorted(r["doc_id"] for r in got) == list(range(1, 11))
    rare = ranked_search.search(spark.createDataFrame([(1, "other")], "item_id long, text string"),
                                spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 10).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in rare) == [(n + 1, 9000 + n) for n in range(10)]


def test_products_are_exact():
    """Weights so large that a block holds two terms: the same whole numbers as with integers."""
    rng = np.random.default_rng(1)
    terms = [b"t%d" % i for i in range(300)]
    weights = rng.integers(1, 2**32, (5, 300)).astype(float)
    docs = 40
    doc = np.repeat(np.arange(docs), 300)
    tile = (list(range(docs)), None, np.full(docs, 300), terms, np.tile(np.arange(300), docs), rng.integers(1, 9, docs * 300))
    norms = rng.integers(10, 300, docs)
    got = ranked_search.scores(tile, {t: i for i, t in enumerate(terms)}, weights, norms)
    impact = 10**9 * tile[5] // (1000 * tile[5] + 8 * norms[doc])
    want = [[sum(int(w) * int(x) for w, x in zip(weights[i], impact[doc == d], strict=True)) for d in range(docs)] for i in range(5)]
    assert got.tolist() == want
