"""Each operator against brute force, on the fixture and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, html_text, itq, jaccard, lm, packing, substring, token_counts, toxicity
from quarry.llm.queries import ORACLES, QUERIES
from quarry.oracle import compare
from quarry.plans.registry import Query

LONG = "word%d " * 3000 % tuple(range(3000))
ROWS = [(1, "The cat sat on the mat today."), (2, "the CAT sat on the mat today."), (3, None), (4, ""), (5, "   \n\t "),
        (None, "The cat sat on the mat today."), (6, LONG), (7, LONG + "tail"), (8, "a b"), (8, "a b"), (9, "A b"),
        (10, "x " * 200), (11, "Ünïcødé　текст 漢字 \x1c<|endoftext|> don't 123")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank, long and repeated rows, with extra columns of clashing names."""
    rows = [(*r, "en", i, "z") for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n int, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    ok, message = compare(spark, duck, Query(name, "llm", QUERIES[name], ORACLES[name]), sf_dir)
    assert ok, message


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- 1: embeddings ----------------------------------------------------------------------

@pytest.mark.parametrize("spread", [0.0, 0.3, 0.6])
def test_itq_recall_with_a_common_direction(spark, spread):
    """Vectors everywhere, and close around one direction, each with a partner just above the threshold."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = unit(rng.standard_normal((800, 64)))
    if spread:
        x = unit(unit(rng.standard_normal((1, 64))) + spread * x)
    x = np.concatenate([x, itq.partners(x, 0.983, 7)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert (itq.fit(df, "vec_id", "embedding")[1][:2] == itq.TABLES[0]) == (spread == 0)
    got = by_id(itq.near_duplicates(df), "vec_id")
    hit = (x @ x.T >= itq.THRESHOLD) & ~np.eye(len(x), dtype=bool)
    found = sum(min(got[i].n_links, int(n)) for i, n in enumerate(hit.sum(axis=1)))
    assert found >= 0.97 * hit.sum() and all(got[i].n_links <= n for i, n in enumerate(hit.sum(axis=1)))


# -- 2: byte-level BPE ------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference_bpe():
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, sf_dir, texts, reference_bpe):
    got = by_id(QUERIES["op2_prefix_bpe"](spark, sf_dir))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = reference_bpe.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_awkward(awkward, empty, reference_bpe):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode(bpe.encode(awkward, path, public_tokenizers.PATTERN), path).collect()
    want = collections.Counter((i, (t or "").encode(), tuple(reference_bpe.encode_ordinary(t or ""))) for i, t in ROWS)
    assert collections.Counter((r.doc_id, bytes(r.decoded), tuple(np.frombuffer(r.ids, "<u4").tolist()))
                               for r in got) == want
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_appends_and_edits():
    vocabulary = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rng = np.random.default_rng(0)
    letters = b"abeinrst"
    data = bytes(rng.choice(list(letters), 400).tolist())
    grown = bpe.PrefixEncoder(vocabulary)
    for k in range(0, 400, 7):
        grown.append(data[k:k + 7])
    assert grown.ids() == bpe.PrefixEncoder(vocabulary, data).ids() == vocabulary.merge(data)
    for _ in range(30):
        a, b = sorted(rng.integers(0, len(data) + 1, 2).tolist())
        b = min(b, a + 5)
        new = bytes(rng.choice(list(letters), int(rng.integers(0, 6))).tolist())
        data = data[:a] + new + data[b:]
        grown.replace(a, b, new)
        assert grown.data == data and grown.ids() == vocabulary.merge(data)
    far = len(data) - 300
    assert grown.replace(far, far + 1, b"e") < 250      # not all the rest


# -- 3: toxicity ------------------------------------------------------------------------

def test_toxicity_learns_grades():
    rng = np.random.default_rng(1)
    x = rng.random((400, 6)) < 0.4
    grades = np.minimum(x[:, 0].astype(int) + x[:, 1], 2)
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit(rows, cols, np.ones(len(rows)), grades, 6)
    assert t[0] < t[1] and min(w[:2]) > 4 * max(abs(w[2:]))
    model = toxicity.Model({}, t)
    p = model.at_least(x @ w)
    assert (p[:, 0] >= p[:, 1]).all()
    assert ((p >= 0.5).sum(axis=1) == grades).mean() > 0.95


def test_toxicity_held_out(spark):
    """Trained on two thirds of the labels of the larger fixture, tested on the rest."""
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 3 != 0"))
    scored = toxicity.severity(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r for r in scored if not r.toxic]
    insults = [r for r in scored if r.toxic and sum(r.text.lower().count(w) for w in ("idiot", "moron", "scum", "clown",
                                                                                    "loser", "stupid", "trash")) > 3]
    assert sum(r.p_toxic >= toxicity.REJECT for r in clean) <= 0.01 * len(clean)
    assert sum(r.p_toxic >= toxicity.REJECT for r in insults) >= 0.95 * len(insults) > 30
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic for r in scored)


def test_toxicity_query(spark, sf_dir, texts):
    """The registered query gives every document one row, toxic labels mostly rejected, clean ones hardly ever."""
    got = by_id(QUERIES["op3_ordinal_toxicity"](spark, sf_dir))
    assert got.keys() == texts.keys() and {"severity", "p_toxic", "grade", "rejected"} <= set(next(iter(got.values())).asDict())
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in got}
    clean = [i for i, t in toxic.items() if not t]
    assert sum(got[i].rejected for i in clean) <= 0.02 * len(clean)
    assert sum(got[i].rejected for i, t in toxic.items() if t) >= 0.8 * (len(toxic) - len(clean)) > 0


def test_toxicity_replaces_columns_of_its_names(spark):
    rows = [(i, "bad words" if i % 2 else "nice words", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, severity string, grade int")
    model = toxicity.train(df, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    got = toxicity.severity(df, model)
    assert got.columns == ["doc_id", "text", "severity", "p_toxic", "grade"] and got.filter("severity > 0.5").count() == 20
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 20


def test_toxicity_sample_holds_rare_words(spark):
    """Of 2,100 toxic rows six hold a word, those that are last by the sample's order."""
    last = {r.id for r in spark.range(2100).orderBy(F.xxhash64("id").desc(), F.desc("id")).limit(6).collect()}
    rows = [(i, "bad words here" + (" zounds" if i in last else "")) for i in range(2100)]
    rows += [(i, "nice words here") for i in range(2100, 4100)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"),
                           spark.createDataFrame([(i, int(i < 2100)) for i, _ in rows], "doc_id long, toxic int"))
    assert toxicity._hash("zounds") in model.weights


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (8, 1), (8, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    kept = toxicity.drop_toxic(awkward, model)
    assert kept.columns == awkward.columns
    assert toxicity.severity(awkward, model).count() == len(ROWS)
    nothing = toxicity.train(empty, labels)
    assert toxicity.drop_toxic(awkward, nothing).count() == len(ROWS)
    assert toxicity.drop_toxic(empty, model).count() == 0


# -- 4: n-gram Jaccard ------------------------------------------------------------------

def brute_jaccard(rows):
    sets = [jaccard.shingles((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared and jaccard.similar(shared, len(sets[i]), len(sets[j])):
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if parent[j] == parent[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return collections.Counter(out)


def test_jaccard_awkward(awkward, empty):
    got = jaccard.groups(awkward).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_jaccard(ROWS)
    assert jaccard.groups(empty).count() == 0
    kept = jaccard.drop_similar(awkward)
    assert kept.columns == awkward.columns


def test_jaccard_one_row_of_each_group_stays(spark):
    """Also of groups whose ids are all null, repeated, or both."""
    words = [f"w{i}" for i in range(120)]
    near = [" ".join([*words[:60], x]) for x in ("a", "b", "c")]
    far = [" ".join([*words[60:], x]) for x in ("a", "b")]
    rows = [(None, near[0], 0), (None, near[1], 0), (None, near[1], 0), (7, far[0], 1), (7, far[1], 1), (7, far[1], 1),
            (8, "one two three", 2), (8, "ONE two three", 2), (None, "one two three", 2),
            (None, "x y z", 3), (None, "x Y z", 3), (9, None, 4), (9, "", 4), (None, " ", 4), (5, near[2] + " d e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    kept = jaccard.drop_similar(df).collect()
    assert collections.Counter(r.n for r in kept) == {1: 1, 2: 1, 3: 1, 4: 3, 5: 1}
    assert {r.n: r.doc_id for r in kept if r.n < 4} == {1: 7, 2: 8, 3: None}


def test_jaccard_edited_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choice(words, 40))
    rows = []
    for g in range(12):
        base = rng.choice(words, 120).tolist()
        for c in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 6))):
                text[int(rng.integers(0, len(text)))] = f"edit{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(text) + (" " + passage if g % 2 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.groups(df).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_jaccard(rows)


def test_jaccard_link_counts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows = list(ROWS)
    for g in range(3):
        base = rng.choice(words, 100).tolist()
        for _ in range(8 + 20 * g):            # the larger groups have common tokens
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(0, len(text)))] = f"edit{rng.integers(0, 10**9)}"
            rows.append((len(rows) + 100, " ".join(text)))
    sets = [jaccard.shingles((t or "").encode()) for _, t in rows]
    want = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared and jaccard.similar(shared, len(sets[i]), len(sets[j])):
                want[i] += 1
                want[j] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.link_counts(df).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == \
        collections.Counter((doc, len(s), n) for (doc, _), s, n in zip(rows, sets, want, strict=True))
    assert len({n for n in want if n > jaccard.COMMON}) > 3


def test_jaccard_writes_shared_tokens_only(spark, monkeypatch):
    """What blocks send is shuffled, not written, and a token that only copies of one text hold is not found in it."""
    written = []
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1)
    monkeypatch.setattr(jaccard, "materialise", lambda df, keep=jaccard.materialise: written.append(keep(df)) or written[-1])
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:100])] * 20 + [" ".join(words[200:300]), " ".join([*words[200:300], "more"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    _, rows, rare, common = jaccard._holders(df, 5)
    assert rows.count() == 22 and not any("payload" in w.columns for w in written)
    nodes = {jaccard.node_of(t.encode()) for t in texts[20:]}
    assert common.isEmpty() and {r.node for r in rare.collect()} == nodes
    assert {r.doc_id: r.component_id for r in jaccard.groups(df).collect()} == {i: 20 * (i >= 20) for i in range(22)}


def test_jaccard_sent_tokens_come_back():
    """Whole columns, with little beside them."""
    rng = np.random.default_rng(2)
    for size in (0, 1, 75):
        token, names = rng.integers(0, 2**64, size, np.uint64), rng.integers(-2**63, 2**63, size)
        counts, holders = rng.integers(1, 60000, size), rng.choice([1, 1, 1, 2, 300], size)
        one = holders == 1
        packed = jaccard._pack_tokens(token, names, counts, holders)
        assert len(packed) <= 18 * size + 20
        for got, want in zip(jaccard._unpack_tokens(packed), (token[one], names[one], counts[one], token[~one],
                                                              np.minimum(holders[~one], 255)), strict=True):
            assert got.tolist() == want.tolist()


@pytest.mark.parametrize("marks", [1, 3, 1000])
def test_jaccard_marks_lose_no_pair(spark, monkeypatch, marks):
    """Tokens of one node may have the same mark."""
    monkeypatch.setattr(jaccard, "_mark", lambda token: F.expr(f"cast(pmod({token}, {marks}) as int)"))
    rng = np.random.default_rng(marks)
    held = [(t, i, 60, i) for i in range(30) for t in rng.choice(40, 12, replace=False).tolist()]
    tokens = collections.defaultdict(set)
    for t, i, _, _ in held:
        tokens[i].add(t)
    need = (4 * 120 + 8) // 9 - 48 + 1
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if len(tokens[i] & tokens[j]) >= need}
    df = spark.createDataFrame(held, "token long, node long, n long, component long")
    got = {(r.u, r.v) for r in jaccard._remaining_pairs(df, True).collect()}
    assert want and got >= want and (marks < 1000 or got == want)


def test_prefix_filter_is_safe():
    classes = np.zeros(jaccard.CELLS, np.uint8)
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x[rng.random(len(x)) < 0.9]
        y = np.unique(np.concatenate([y, rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)]))
        if len(y) and jaccard.similar(len(np.intersect1d(x, y)), len(x), len(y)):
            for order in range(3):
                assert np.isin(jaccard.prefix(x, classes, order), jaccard.prefix(y, classes, order)).any()


def test_jaccard_blocks_equal_brute_force():
    """Two blocks, and one with itself: linked pairs of different components, as counted one by one."""
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 3, jaccard.CELLS).astype(np.uint8)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)

    def block(n):
        sets = [np.unique(np.concatenate([base[rng.random(300) < rng.choice([0.8, 0.9, 0.97])],
                                          rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(n)]
        return (np.arange(n), rng.integers(0, 4, n), np.array([len(x) for x in sets]), np.concatenate(sets)), sets

    (a, x), (b, y) = block(60), block(45)
    for first, s, second, t, same in ((a, x, b, y, False), (a, x, a, x, True)):
        want = [[bool(first[1][i] != second[1][j] and (not same or i < j)
                      and jaccard.similar(len(np.intersect1d(u, v)), len(u), len(v))) for j, v in enumerate(t)] for i, u in enumerate(s)]
        assert jaccard.block_links(first, second, classes, same).tolist() == want and np.any(want)


@pytest.mark.parametrize("hot,block", [(8, 16), (2, 128)])
def test_jaccard_hot_tokens_in_blocks(spark, monkeypatch, hot, block):
    """Copies with more and more changes of one text, and near misses of it: groups as by brute force."""
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(hot)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    got = by_id(jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    sets = [set(jaccard.shingles(t.encode()).tolist()) for _, t in rows]
    root = list(range(150))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(150):
        for j in range(i):
            if jaccard.similar(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                links += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert links > 50 and len({top(i) for i in range(150)}) > 5
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i in range(150)}


# -- 5: exact dedup ---------------------------------------------------------------------

def test_exact_awkward(awkward, empty):
    got = exact_dedup.groups(awkward).collect()
    lower = [(i, (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in ROWS]
    best = {}
    for i, t in lower:
        ids = [j for j, u in lower if u == t and j is not None]
        best[t] = (max(ids) if ids else None, sum(u == t for _, u in lower))
    want = collections.Counter((i, *best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in lower)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(best)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.dedup(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(best)
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_exact_filter_full(awkward, monkeypatch):
    """A filter that is far too small sends all rows the exact way, with the same result."""
    want = collections.Counter(exact_dedup.groups(awkward).collect())
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 2)
    assert collections.Counter(exact_dedup.groups(awkward).collect()) == want


# -- 6: HTML ----------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></ul></nav>
<div class="cookie-notice"><p>This site uses cookies to remember what you like to read here</p></div>
<main><article><header><h2>A  title</h2></header><p>First &amp; foremost, a paragraph &lt;of&gt; text&hellip;</p><p>Short.
<aside>Buy this product now and never regret it again</aside><p>Has <a href="x">a link</a> and<br>a break.</p>
<form><p>Your mail address here</p><input></form></article><section id="comments"><p>I liked it very much, thanks for
 writing this</p></section></main><footer>&copy; 2020</footer><!-- <p>x</p> --></body></html"""


def test_html_page():
    text = html_text.main_text(PAGE, html_text.train())
    assert text == "A title\nFirst & foremost, a paragraph <of> text…\nShort.\nHas a link and a break."


def test_html_without_article():
    body = "Plain words of a longer paragraph that goes on for quite some time and then some more words. " * 2
    page = f"<div><a href=1>Home</a> <a href=2>About</a></div><p>{body}</p><p>{body}</p><div class='ads'>{body}</div>"
    assert html_text.main_text(page, html_text.train()) == "\n".join([" ".join(body.split())] * 2)


def test_html_named_section():
    """A class or id word inside an article gives way to long blocks without links."""
    body = "The patient grew up by the sea and worked for many years as a teacher in the small town of their birth. " * 2
    ads = "<div class='related'><ul><li><a href=1>Read this</a></li><li><a href=2>And this one too</a></li></ul></div>"
    page = (f"<article><h1>Case report</h1><p>{body}</p><section id='social-history'><h2>Social history</h2><p>{body}</p>"
            f"<p>{body}</p></section>{ads}<div class='ad'><p>Buy now</p></div><p id='legal-status'>{body}</p></article>")
    line = " ".join(body.split())
    assert html_text.main_text(page, html_text.train()) == "\n".join(
        ["Case report", line, "Social history", line, line, line])


LONG_LINE = "A long paragraph of the article that goes on for quite some words so that nobody doubts it is real text at all."
SENTENCE = "Please leave this one plain sentence of sixteen words or more here so it looks like text to all."


@pytest.mark.parametrize("opening,stays", [
    ('<section class="comments">', False), ('<div id="cookie-notice">', False), ('<div class="newsletter">', False),
    ('<div class="related">', False), ('<div class="comment-list">', False), ('<article class="comment">', False),
    ('<div class="advert box">', False), ('<div role="alert">', False), ('<section id="social-history">', True),
    ('<section id="legal-status">', True), ('<div class="side-effects">', True), ('<div class="story comments-open">', True)])
def test_html_inside_an_article(opening, stays):
    """Comments, notices and adverts go however long; a name that only resembles them gives way to length."""
    closing = f"</{opening[1:].split()[0]}>"
    page = f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG_LINE}</p>{opening}<p>{SENTENCE}</p>{closing}<p>{LONG_LINE}</p></article>"
    want = ["Title", LONG_LINE, *[SENTENCE] * stays, LONG_LINE]
    assert html_text.main_text(page, html_text.train()) == "\n".join(want)


@pytest.mark.parametrize("opening", ['<div class="post comments-open">', '<div class="page with-sidebar">', '<form id="f">',
                                     '<div class="social">', '<div class="banner-page">', '<section class="has-cookie-notice">'])
def test_html_wrappers_keep_their_article(opening):
    """Without <article> a wrapper named after chrome, or after a state, keeps its text, a short last paragraph too."""
    closing = f"</{opening[1:].split()[0]}>"
    page = (f"<nav><a href=x>Home</a></nav>{opening}<h1>A title</h1><p>{LONG_LINE}</p><p>{LONG_LINE}</p><p>The end.</p>{closing}"
            f"<div class=comments><p>{SENTENCE}</p></div><footer>Imprint</footer>")
    text = html_text.main_text(page, html_text.train())
    assert text.endswith("\n".join([LONG_LINE, LONG_LINE, "The end."])) and SENTENCE not in text and "Imprint" not in text


def test_html_link_lists_and_empty_pages():
    tree = html_text.train()
    links = "".join(f"<li><a href={i}>Story {i}</a></li>" for i in range(5))
    page = f"<main><h1>T</h1><p>{LONG_LINE}</p><ul>{links}</ul><p>{LONG_LINE} <a href=x>More</a></p></main>"
    assert html_text.main_text(page, tree) == f"T\n{LONG_LINE}\n{LONG_LINE} More"
    assert html_text.main_text(f"<nav>{links}</nav><div class=sidebar><p>{SENTENCE}</p></div>", tree) == ""
    assert html_text.main_text(f"<div class=comments><p>{LONG_LINE}</p><p>{LONG_LINE}</p></div>", tree) == ""


def test_html_stray_closing_tags_are_linear():
    import time
    tree = html_text.train()
    start = time.process_time()
    html_text.main_text("<div>" * 8000 + "</li>" * 8000 + "x", tree)
    html_text.main_text("<div class=ad>" * 8000 + "<p>x</p>" * 8000, tree)
    assert time.process_time() - start < 1


def test_html_fixture(spark, sf_dir):
    """The fixture's article is a plain element: cut it out by itself."""
    import html
    import re
    got = by_id(QUERIES["op6_block_tree_text"](spark, sf_dir), "page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        m = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)
        blocks = re.split(r"</?(?:p|h1)>", m.group(1)) if m else []
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", b)).split()) for b in blocks]
        want = "\n".join(x for x in lines if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_html_awkward(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p"), (2, "u", "no tags"), (3, "u", "<b>" * 2000), (4, "u", "a < b <3 &amp"),
            (5, "u", "<p a='" + "x" * 5000), (6, "u", "</div></article><article>x</article>" * 500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_tree_fits_its_table():
    x, y = html_text.labelled_table()
    assert ((html_text.predict(html_text.train(), x) >= 0.5) == y).mean() > 0.97


# -- 7: substring dedup -----------------------------------------------------------------

def brute_substring(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return collections.Counter(out)


def spliced(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [f"v{i}" for i in range(60)]
    shared = [rng.choice(words, int(rng.integers(30, 90))).tolist() for _ in range(8)]
    rows = []
    for i in range(n):
        text = rng.choice(words, int(rng.integers(0, 80))).tolist()
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(0, 8))]
            a = int(rng.integers(0, 30))
            text += s[a:] if rng.random() < 0.5 else s[:len(s) - a]
            text += rng.choice(words, int(rng.integers(0, 20))).tolist()
        rows.append((i, " ".join(text)))
    return rows + rows[:3]


@pytest.mark.parametrize("busy", [2048, 1])
def test_substring_spliced(spark, monkeypatch, busy):
    """With BUSY 1 every border run takes the counted way."""
    monkeypatch.setattr(substring, "BUSY", busy)
    rows = spliced(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring.remove(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_substring(rows, 35)


def test_substring_awkward(awkward, empty):
    got = substring.remove(awkward).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_substring(ROWS, 35)
    cut = substring.cut_documents(awkward)
    assert cut.columns == awkward.columns and cut.count() == len(ROWS)
    assert substring.remove(empty).count() == 0 and substring.cut_documents(empty).count() == 0


def test_suffix_automaton():
    rng = np.random.default_rng(9)
    for _ in range(40):
        seqs = [rng.integers(0, 3, int(rng.integers(1, 12))).tolist() for _ in range(int(rng.integers(1, 6)))]
        machine = substring.SuffixAutomaton(seqs)
        counts = collections.Counter(tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1))
        for s, states in zip(seqs, machine.states, strict=True):
            for i, state in enumerate(states):
                want = max((k for k in range(1, i + 2) if counts[tuple(s[i + 1 - k:i + 1])] > 1), default=0)
                assert machine.elsewhere(state) == want


# -- 8: language model ------------------------------------------------------------------

def brute_lm(rows, order=3):
    tokens = [lm._tokens((t or "").encode()) for _, t in rows]
    count = [None] + [collections.Counter() for _ in range(order)]
    for (doc, _), w in zip(rows, tokens, strict=True):
        if not lm.is_held_out(doc):
            for k in range(1, order + 1):
                count[k].update(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    n, v = sum(count[1].values()), len(count[1])
    kept = [None] + [{g: c for g, c in count[k].items() if c >= lm.CUTOFF} for k in range(1, order + 1)]
    after = collections.defaultdict(list)
    for k in range(2, order + 1):
        for g in kept[k]:
            after[g[:-1]].append(g[-1])

    def p(w, h):
        if not h:
            return (count[1][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        if h not in kept[len(h)]:
            return p(w, h[1:])
        c = kept[len(h)][h]
        taken = sum(kept[len(h) + 1][h + (x,)] - lm.DISCOUNT for x in after[h])
        own = kept[len(h) + 1].get(h + (w,), lm.DISCOUNT) - lm.DISCOUNT
        return own / c + (c - taken) / c * p(w, h[1:])

    out = []
    for (doc, _), w in zip(rows, tokens, strict=True):
        base = sum(math.log10(p(x, ())) for x in w)
        score = sum(math.log10(p(x, tuple(w[max(0, j + 1 - order):j]))) for j, x in enumerate(w))
        out.append((doc, lm.is_held_out(doc), len(w), sum(count[1][(x,)] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_brute_force(spark, order):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 60))))) for i in range(60)] + ROWS
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted((tuple(r) for r in lm.score(df, order).collect()), key=key)
    for a, b in zip(got, sorted(brute_lm(rows, order), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def lm_automaton(rows):
    """(automaton, words, Block, tokens) over the n-grams of all rows, in one block with its own answers."""
    texts = [(t or "").encode() for _, t in rows]
    words = [lm.WORDS.of(lm._tokens(t)) for t in texts]
    names, tokens = np.unique(np.concatenate(words), return_inverse=True)
    lens, held = np.array([len(w) for w in words]), np.array([lm.is_held_out(i) for i, _ in rows])
    b = lm.Block(names, tokens, lens, held, 3)
    goes_on = [None, None, *(np.ones(len(tokens), bool) for _ in range(2))]
    asked = [None, lm.Asked(b, 1, goes_on), lm.Asked(b, 2, goes_on)]
    answers = []
    for a in asked[1:]:
        kept = a.times * (a.times >= lm.CUTOFF)
        answers.append((a.count, np.bincount(a.of, kept, len(a.context)).astype(int),
                        np.bincount(a.of[kept > 0], minlength=len(a.context)), kept))
    trained = ~held[b.doc]
    space = trained.sum() + 0.5 * (len(np.unique(tokens[trained])) + 1)
    return lm.build(b, asked, answers, int((~held).sum()), space)[0], names, b, tokens


def test_lm_probabilities_add_up():
    """In every state the probabilities of all words and an unknown one add up to one."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("abcd"), 30))) for i in range(20)]
    held = next(i for i in range(100, 200) if lm.is_held_out(i))
    automaton, names, _, _ = lm_automaton([*rows, (held, "unknown")])
    assert automaton.root > 12
    for state in range(automaton.root + 1):
        _, weight = automaton.step(np.full(len(names), state), np.arange(len(names)))
        assert (10 ** weight).sum() == pytest.approx(1)


def walk(rows, order=3):
    """States visited by a plain automaton over the kept n-grams: of each text, the longest suffix, of at
    most ``order - 1`` words, that is kept, after each word."""
    tokens = [lm._tokens((t or "").encode()) for _, t in rows]
    count = collections.Counter()
    for (doc, _), w in zip(rows, tokens, strict=True):
        if not lm.is_held_out(doc):
            count.update(tuple(w[j:j + k]) for k in range(1, order) for j in range(len(w) - k + 1))
    out = []
    for w in tokens:
        seen = []
        for j in range(1, len(w)):
            suffixes = [tuple(w[j - k:j]) for k in range(min(order - 1, j), 0, -1)]
            seen.append(next((s for s in suffixes if count[s] >= lm.CUTOFF), ()))
        out.append(seen)
    return out


def test_lm_visits_the_states_of_a_plain_automaton(spark, monkeypatch):
    """One pass that carries the state: after every word it is the longest suffix that is a state, in lanes of five words too."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(list("abcdefghij"), int(rng.integers(1, 40))))) for i in range(50)]
    automaton, _, b, tokens = lm_automaton(rows)
    lens = b.lens
    want = walk(rows)
    name_of = {automaton.root: ()}
    state, at = np.full(len(rows), automaton.root), np.cumsum(lens) - lens
    for t in range(int(lens.max()) - 1):
        live = np.flatnonzero(lens - 1 > t)
        state[live], _ = automaton.step(state[live], tokens[at[live] + t])
        for d in live.tolist():
            assert name_of.setdefault(int(state[d]), want[d][t]) == want[d][t]
    assert len(name_of) == len(set(name_of.values())) > 50
    whole = automaton.scores(tokens, lens, 2)
    monkeypatch.setattr(lm, "LANE", 5)
    assert automaton.scores(tokens, lens, 2) == pytest.approx(whole)
    assert whole.tolist() == pytest.approx([r[6] for r in brute_lm(rows)])


def test_lm_asks_by_word_numbers(monkeypatch):
    """Names made of word numbers are a permutation; words without a number are not asked for, nor n-grams that hold one; names
    too long for 64 bits are hashed, with the same scores."""
    for bits in (1, 2, 7, 12):
        assert sorted(lm._scramble(np.arange(1 << bits, dtype=np.uint64), bits).tolist()) == list(range(1 << bits))
    rng = np.random.default_rng(4)
    tokens, lens = rng.integers(0, 9, 60), np.array([20, 40])
    ids = np.where(np.arange(9) == 4, -1, 3 * np.arange(9))
    b = lm.Block(np.arange(9, dtype=np.uint64), tokens, lens, np.zeros(2, bool), 3, ids, np.zeros(9, np.int64), 5)
    flags = [None, None]
    for k in (2, 3):
        flags.append(np.zeros(60, bool))
        flags[k][b.inside[k]] = b.numbered(k)
    pairs = {(tokens[t - 1], tokens[t]) for t in range(60) if t not in (0, 20, 19, 59)} | {(tokens[t - 1], tokens[t]) for t in (19, 59)}
    one, two = lm.Asked(b, 1, flags), lm.Asked(b, 2, flags)
    assert set(one.context.tolist()) == {int(x) for t in range(60) if t not in (19, 59) and tokens[t] != 4
                                         for x in lm._scramble(np.array([ids[tokens[t]]], np.uint64), 5)}
    assert sorted(one.name.tolist()) == sorted(ids[y] for x, y in pairs if 4 not in (x, y))
    assert max(two.context.tolist()) < 1 << 10 and len(two.context) == len({(tokens[t - 1], tokens[t]) for t in range(1, 59)
                                                                          if t not in (19, 20) and 4 not in tokens[t - 1:t + 1]})
    rows = [(i, " ".join(rng.choice(list("abcdefghij"), 20))) for i in range(30)]
    whole, _, b, tokens = lm_automaton(rows)
    monkeypatch.setattr(lm.Block.__init__, "__defaults__", (None, None, 33))
    hashed, _, wide, _ = lm_automaton(rows)
    assert wide.bits(2) == 64 and hashed.scores(tokens, b.lens, 2) == pytest.approx(whole.scores(tokens, b.lens, 2), rel=1e-12)


def test_lm_shuffles_documents_once(spark, sf_dir):
    df = lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]


def test_lm_spreads_common_words(spark):
    """A word of half of all tokens: its context is asked of several partitions, with the same scores."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(x for w in rng.choice(list("bcdefghijk"), 20) for x in ("the", w))) for i in range(60)]
    words = np.array([lm.WORDS[b"the"]], np.uint64)
    assert lm.Shares({int(words[0]): 50}, 100, 32).of(words).tolist() == [0.5]
    got = by_id(lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = {r[0]: r[6] for r in brute_lm(rows)}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, rel=1e-9)


def test_lm_beats_base_on_held_out(spark, sf_dir):
    rows = QUERIES["op8_backoff_automaton"](spark, sf_dir).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(math.isfinite(r.score) for r in rows)


@pytest.mark.parametrize("copies", [1, 12])
def test_lm_keeps_states_at_any_size(spark, copies):
    """An n-gram seen twice is a state however long the other training texts are."""
    rng = np.random.default_rng(6)
    rows = [(i, "one two three four") for i in range(2)]
    rows += [(i + 2, " ".join(rng.choice(list("abcdefghijkl"), 40 * copies))) for i in range(40)]
    want = {r[0]: r[6] for r in brute_lm(rows)}
    got = by_id(lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, rel=1e-9)


def test_lm_empty(empty):
    assert lm.score(empty).count() == 0


# -- 9: packing -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_pieces(pieces, docs, tokenizer):
    assert sorted(p.sequence_id for p in pieces) == list(range(len(pieces)))
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.offset == 0
            assert p.length & (p.length - 1) == 0 and p.length <= packing.MAX_LENGTH
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at:at + p.length]))
            at += p.length
        assert at == len(ids)


def test_packing_query(spark, sf_dir, texts, word_tokenizer):
    check_pieces(QUERIES["op9_binary_packing"](spark, sf_dir).collect(), texts.items(), word_tokenizer)


def test_packing_awkward(awkward, empty, word_tokenizer):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(awkward, path).collect()
    single = [(i, t) for i, t in ROWS if i not in (8, None)]
    assert sorted(p.sequence_id for p in got) == list(range(len(got)))
    for doc, text in single:
        ids = word_tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert sum(p.length for p in got if p.doc_id == doc) == len(ids)
    assert packing.pack(empty, path).count() == 0


def test_piece_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        got = packing.piece_lengths(n)
        assert sum(got) == n and got == sorted(got, reverse=True)
        assert collections.Counter(got).most_common(1)[0][1] == 1 or got[0] == 2048


# -- 10: token counts -------------------------------------------------------------------

def test_token_counts(spark, sf_dir, texts):
    t = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(QUERIES["op10_pretoken_counts"](spark, sf_dir))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)


def test_token_counts_awkward(awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = token_counts.tokenizer(path)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(awkward, path).collect())
    assert got == collections.Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids))
                                      for i, x in ROWS)
    assert token_counts.token_counts(empty, path).count() == 0


# -- 1: embeddings ----------------------------------------------------------------------

def brute_links(rows, threshold=0.98):
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    parent, n = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) \
                    and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if parent[j] == parent[i] and rows[j][0] is not None]
        out.append((vec, n[i], min(ids) if ids else None))
    return out


def planted_vectors():
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 12))):
            v = base + rng.standard_normal(64) * rng.uniform(0, 0.12) * np.linalg.norm(base) / 8
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], g % 3))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], None), (1002, None, 1), (1003, [0.0] * 64, 1),
             (1004, [None] + [1.0] * 63, 1), (1005, [float("nan")] * 64, 1), (1006, [], 1), (1007, [1.0, 2.0], 1),
             (1008, [2.0, 4.0], 1), (None, rows[5][1], rows[5][2])]
    return rows


def test_itq_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 4)
    rows = planted_vectors()
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows)
    found, true = sum(r.n_links for r in got.values()), sum(n for _, n, _ in want)
    assert 0.97 * true <= found <= true
    assert all(got[v].n_links <= n for v, n, _ in want)
    for v in (1001, 1002, 1003, 1004, 1005, 1006):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (0, v, True)
    assert got[1007].component_id == got[1008].component_id == 1007


def test_itq_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq.near_duplicates(df).count() == 0


# -- op8: names and orders of many at once ------------------------------------------------

def test_lm_word_names_of_many_texts():
    """Equal words of any length have one name wherever they stand, different ones have different names, and
    each text ends with the end token."""
    texts = [b"", b" \t\x0b", b"The the THE", b"a ab abc abcdefg abcdefgh abcdefghi", "Ä ä b".encode(),
             b"x" * 16 + b" " + b"x" * 17 + b"\r\n" + b"x" * 8 + b"\x0c" + b"x" * 24, b" the\x00 the \x1c "]
    names, lens = lm._word_names(texts)
    tokens = [lm._tokens(t) for t in texts]
    assert lens.tolist() == [len(t) for t in tokens]
    flat = [w for t in tokens for w in t]
    assert len(set(zip(flat, names.tolist(), strict=True))) == len(set(flat)) == len(set(names.tolist()))


def test_lm_orders_and_packed_tokens():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    names[::7] = names[0] + np.arange(len(names[::7]), dtype=np.uint64) % np.uint64(5)      # differ in the last bits only
    assert (names[lm.order_names(names)] == np.sort(names)).all()
    small = rng.integers(0, 9, 500)
    assert (lm._order(small) == np.argsort(small, kind="stable")).all()
    distinct, which = lm.unique_of(names, lm.order_names(names))
    assert (distinct == np.unique(names)).all() and (distinct[which] == names).all()
    classes, numbers = lm._by_use(distinct, which)
    assert (np.concatenate([lm._unpack_names(c) for c in classes])[numbers] == names).all()
    assert len(lm._order(small[:0])) == len(lm.order_names(names[:0])) == 0


# -- op9: words of many texts at once ---------------------------------------------------

def test_packing_ids_equal_the_library(word_tokenizer, monkeypatch):
    """Letters of any script and case, marks, other white space, special strings, and a cache that forgets; also with
    hashes that all collide."""
    rng = np.random.default_rng(11)
    pieces = ["the", "The", "THE", "naïve", "NAÏVE", "straße", "İx", "İ", "H̱a", "J̌", "é", "ſ", "Ωmega", "ΣΑΣ", "漢字", "١٢",
              "don't", "x's.", "...", "'s", "***", "###", "a.b", "é!", "<|endoftext|>", "<|ENDOFTEXT|>", "ab<|startoftext|>c", " ", "a　b",
              " ", "\x1c", "\x00", "ª", "ǆ", "ß" * 40, "k" * 70, "12", "a1", "😀", "K", "q̣̇"]
    texts = ["".join(x for p in rng.choice(pieces, n) for x in (str(p), str(rng.choice(["", "", " ", "\n", "\t "])))) for n in range(60)]
    texts += ["", " ", *pieces]
    want = [struct.pack(f"<{len(i)}I", *i) for i in ([*word_tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts)]
    data, end, path = [t.encode() for t in texts], struct.pack("<I", 1), public_tokenizers.path("word_bpe_49k.json")
    assert packing.encode_texts(packing.WordIds(path), data, end) == want
    small = packing.WordIds(path, limit=8)
    assert small.letters is not None
    assert packing.encode_texts(small, data, end) == want and len(small) + len(small.old) <= 8
    monkeypatch.setattr(packing.Words, "names", lambda self: np.zeros(len(self.start), np.uint64))
    assert packing.encode_texts(small, data, end) == want
    assert packing.encode_texts(small, [], end) == []


def test_packing_encodes_a_word_of_a_batch_once():
    class Counting(dict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return b"\x02\0\0\0" * len(word)

    cache = Counting()
    assert packing.encode_texts(cache, [b"a bb a", b"bb a"] * 50, b"")[:2] == [b"\x02\0\0\0" * 4, b"\x02\0\0\0" * 3]
    assert cache.asked == 2


def test_packing_table_equals_the_library(word_tokenizer, monkeypatch):
    """Words looked up as arrays: those of more than eight bytes and more than 64, a table that forgets, hashes that collide
    within a slice and between slices, and slices of one text."""
    rng = np.random.default_rng(12)
    words = [str(w) for w in rng.choice(["the", "The", "naïve", "straße", "x's.", "...", "a.b", "漢字", "a　b", "k" * 70, "extraordinary",
                                         "extraordinarily", "<|endoftext|>ab", "\x1c"], 40)] + [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 40, 200, 3, 80)] * 3
    want = [struct.pack(f"<{len(i)}I", *i) for i in ([*word_tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts)]
    data, end, path = [t.encode() for t in texts], struct.pack("<I", 1), public_tokenizers.path("word_bpe_49k.json")
    cache = packing.WordIds(path)
    for limit in (0, 1, 8, 50, 1 << 10):
        table = packing.WordTable(limit)
        for most in (1, 500, 1 << 20):
            assert [x for s in packing._slices(data, most) for x in packing.encode_texts(cache, s, end, table)] == want
            assert len(table) <= max(limit, 0)
    assert [len(s) for s in packing._slices([b"aaa", b"b", b"", b"cccccc", b"d"], 4)] == [3, 1, 1]
    found = packing.Words.names
    monkeypatch.setattr(packing.Words, "names", lambda self: found(self) & np.uint64(7))
    table = packing.WordTable()
    assert [x for t in data for x in packing.encode_texts(cache, [t], end, table)] == want
    one_by_one = [w.encode() for w in words]                       # no two words of a slice: only the table sees equal names
    library = [struct.pack(f"<{len(i)}I", *i) for i in (word_tokenizer.encode(w, add_special_tokens=False).ids for w in words)]
    assert [packing.encode_texts(cache, [w], b"", table)[0] for w in one_by_one * 2] == library * 2 and 0 < len(table) <= 8


def test_packing_worker_memory():
    """A worker keeps less than 100 bytes for a word met."""
    import gc
    import tracemalloc

    import pyarrow as pa

    run = packing._tokenise(public_tokenizers.path("word_bpe_49k.json"), 1)
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    list(run([batch(["a"])]))
    gc.collect()
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    texts = [" ".join(f"{i:x}q{j:x}" for j in range(1000)) for i in range(200)]
    for _ in run([batch(texts)]):
        pass
    del texts, _
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    packing._CACHES.clear()
    assert kept < 100 * 200_000


def test_a_worker_keeps_the_caches_of_one_operator():
    from quarry.llm.common import WORDS

    path = public_tokenizers.path("word_bpe_49k.json")
    packing.word_ids(path)
    assert packing._CACHES
    WORDS.of([b"a"])
    assert not packing._CACHES and b"a" in WORDS
    packing.word_ids(path)
    assert packing._CACHES and not WORDS


def test_a_worker_that_waits_keeps_no_words():
    """At the end of a task the words met go; ids come in short batches, and the next task has the same."""
    import pyarrow as pa

    from quarry.llm.common import WORDS

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{i}a{j}" for j in range(i % 70)) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    first, again = ([*packing._tokenise(path, 1)([batch])] for _ in range(2))
    cache, table = packing._CACHES[path]
    assert len(table) == len(cache) == len(cache.old) == 0
    assert max(b.num_rows for b in first) <= packing.SLICE_ROWS and first == again
    found = pa.Table.from_batches(first)
    assert found.column("doc_id").to_pylist() == batch.column("doc_id").to_pylist()
    end = np.array([1], "<u4").tobytes()
    assert found.column("ids").to_pylist() == packing.encode_texts(packing.WordIds(path), [t.encode() for t in texts], end)
    assert [*jaccard._set_rows(None, jaccard.SIZE)([batch])] and not WORDS
    opened = pa.RecordBatch.from_pydict({"node": [1], "copies": [1], "open": [b""], "body": [b"a text without runs"]})
    assert not [*substring._open_runs(substring.LENGTH)([opened])] and not WORDS
