"""Substring de-duplication by suffix automata of reference shards.

A word is removed if a window of ``LENGTH`` consecutive words that covers it
starts anywhere else too, in the same or any other document.

Streaming every document through the automata of the whole corpus would be
quadratic, so documents and automata are first brought together by anchors.
A window's anchor is the last of its least-hashed ``GRAM``-grams; equal windows
have equal anchors at equal places. Consecutive windows with the same anchor
are a run (about one for twelve words). One exchange of packed run hashes settles
most runs: an anchor that occurs once has no repeated window, and of a run
that occurs twice every window is repeated. What is left are runs that share
their anchor with different runs: the borders of repeated passages. The
words of these runs (one copy of each different run) form the reference
shards, keyed by anchor. Each shard builds the suffix automaton of an
anchor's runs and reads each run's matching statistics off it: the longest
suffix at every word that occurs elsewhere in the reference. Where it is at
least LENGTH long, the window that ends there is repeated; the union of
those windows is the union of the maximal spans above the threshold.

Skew. A block of documents (see ``blocks``) sends each different run once,
marked if it holds it several times. Of an anchor with more than ``BUSY``
different runs in a block only a mark is sent; all runs of such an anchor,
and the different runs of anchors with more than BUSY of them in total, take an
exact path without automata: their windows are counted by hash, combined before the
shuffle, and joined back (a skewed join that adaptive execution splits). Documents
without a repeated anchor are never shuffled.

Defined results: null text has no words; texts shorter than a window lose
nothing; equal rows are documents of their own, so a copied text of LENGTH
words or more loses all its words; ids may be null or repeated.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quarry.llm import blocks as B
from quarry.llm.common import WORDS, bounded_batches, end_task, mix64, shuffle_partitions, text_rows, window_hashes
from quarry.session import materialise

LENGTH = 35
GRAM = 8
BUSY = 2048
#: Text names sent to every task at most (8 bytes each); beyond, all texts are joined.
MAX_NODES = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)

REPEATED, BORDER, REFERENCE, COUNTED, COUNTED_REFERENCE = 1, 2, 3, 4, 5


def node_of(text: bytes) -> int:
    """A signed 64-bit name of the text."""
    import xxhash
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def runs(words: np.ndarray, length: int, gram: int = GRAM):
    """(anchor hash, run hash, first window, windows) of each run of windows."""
    span = length - gram + 1
    if len(words) < length:
        empty = np.empty(0, np.uint64)
        return empty, empty, np.empty(0, np.int64), np.empty(0, np.int64)
    grams = window_hashes(words, gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, span)[:, ::-1].argmin(axis=1)
    anchor = np.arange(len(least)) + span - 1 - least
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(first, append=len(anchor))
    # hash of the words a..b-1: differences of sums of word * base**place, brought to one place
    power = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:len(words)])])
    end = first + count + length - 1
    whole = (sums[end] - sums[first]) * power[len(words) - first] * _inverse(len(words))
    place = anchor[first] - first
    return grams[anchor[first]], mix64(whole ^ mix64((count * 128 + place).astype(np.uint64))), first, count


def _inverse(n: int) -> np.uint64:
    """1 / base**n modulo 2**64."""
    return np.uint64(pow(pow(_BASE, n, 1 << 64), -1, 1 << 64))


# -- settling runs ----------------------------------------------------------------------

def _send(parts: int, length: int):
    """docs: a block's texts (by name) with their runs. Else: the block's different
    runs of one partition as (anchor, run key, 1 several + 2 busy)."""
    def rows(batches):
        for block, _, texts in B.blocks(batches, as_bytes=True):
            copies: dict[int, int] = {}
            anchor, key, first, count, sizes = [], [], [], [], []
            for text in texts:
                node = node_of(text)
                copies[node] = copies.get(node, 0) + 1
                if copies[node] == 1:
                    found = runs(WORDS.of(text.split()), length)
                    for to, values in zip((anchor, key, first, count), found, strict=True):
                        to.append(values)
                    sizes.append(len(found[0]))
            anchor, key = np.concatenate(anchor), np.concatenate(key)
            times = np.repeat(np.fromiter(copies.values(), np.int64, len(copies)), sizes)
            # busy anchors: one entry, and the anchor's own key for all their runs
            order = np.lexsort((key, anchor))
            a, k, t = anchor[order], key[order], times[order]
            new_a = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.empty(0, bool)
            new_k = new_a | np.concatenate([[True], k[1:] != k[:-1]]) if len(a) else new_a
            group = np.cumsum(new_a) - 1
            busy = np.bincount(group, weights=new_k)[group] > BUSY if len(a) else new_a
            k = np.where(busy, mix64(a + np.uint64(1)), k)
            key = key.copy()
            key[order] = k
            new_k = np.where(busy, new_a, new_k).astype(bool)
            entry = np.cumsum(new_k) - 1
            several = np.bincount(entry, weights=t) > 1 if len(a) else new_a
            a, k, busy = a[new_k], k[new_k], busy[new_k]
            yield block % parts, block, True, pickle.dumps(
                (np.array(list(copies), np.int64), np.array(list(copies.values()), np.int64), np.array(sizes), key,
                 B._small(np.concatenate(first)), B._small(np.concatenate(count))), 5)
            part = (a >> np.uint64(7)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mine = order[x:y]
                yield int(part[mine[0]]), block, False, pickle.dumps(
                    (a[mine], k[mine], (several[mine] + 2 * busy[mine]).astype(np.uint8)), 5)
        end_task()

    return lambda batches: B.row_batches(rows(batches))


def _settle(table: pa.Table) -> pa.Table:
    """Answers each block with the state of its runs that may have repeated windows."""
    out, blocks, parts = [], [], []
    for block, docs, payload in zip(*(table.column(c).to_pylist() for c in ("block", "docs", "payload")), strict=True):
        if docs:
            out.append((0, block, True, payload))
        else:
            blocks.append(block)
            parts.append(pickle.loads(payload))
    if parts:
        lens = [len(p[0]) for p in parts]
        anchor, key, flag = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((key, anchor))
        a, k = anchor[order], key[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_k = new_a | np.concatenate([[True], k[1:] != k[:-1]])
        of_a, of_k = np.cumsum(new_a) - 1, np.cumsum(new_k) - 1
        different = np.bincount(of_a, weights=new_k)
        busy = np.bincount(of_a, weights=flag[order] & 2) > 0      # some block has sent a mark alone
        counted = busy | (different > BUSY)
        repeated = (np.bincount(of_k) > 1) | (np.bincount(of_k, weights=flag[order] & 1) > 0)
        state = np.where(repeated[of_k], REPEATED, 0)
        shared = different[of_a] > 1
        state = np.where(shared & ~repeated[of_k], BORDER, state)
        state = np.where(shared & repeated[of_k] & new_k, REFERENCE, state)
        known = np.where(repeated[of_k], np.where(new_k, COUNTED_REFERENCE, REPEATED), COUNTED)
        state = np.where(counted[of_a], np.where(busy[of_a], COUNTED, known), state)
        back = np.empty(len(state), np.uint8)
        back[order] = state
        at = 0
        for block, n in zip(blocks, lens, strict=True):
            mine = back[at:at + n]
            use = mine > 0
            if use.any():
                out.append((0, block, False, pickle.dumps((key[at:at + n][use], mine[use]), 5)))
            at += n
    return pa.Table.from_batches([B.batch_of(out)])


def _spans(starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Window intervals [start, end) as unsigned 32-bit pairs."""
    return np.stack([starts, starts + counts], axis=1).astype(np.uint32).tobytes()


def _by_text(table: pa.Table) -> pa.Table:
    """(node, copies, done, open): the repeated windows of a block's texts and the
    runs still open, as (first window, windows, state)."""
    docs, found = None, []
    for is_docs, payload in zip(table.column("docs").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if is_docs:
            docs = pickle.loads(payload)
        else:
            found.append(pickle.loads(payload))
    node, copies, sizes, key, first, count = docs
    state = np.zeros(len(key), np.uint8)
    if found and len(key):
        keys, states = np.concatenate([k for k, _ in found]), np.concatenate([s for _, s in found])
        order = np.argsort(keys)
        keys, states = keys[order], states[order]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        state = np.where(keys[at] == key, states[at], 0)
        is_reference = (state == REFERENCE) | (state == COUNTED_REFERENCE)
        reference = np.flatnonzero(is_reference)       # one copy of a run is enough
        once = np.zeros(len(key), bool)
        once[reference[np.unique(key[reference], return_index=True)[1]]] = True
        state = np.where(is_reference & ~once, REPEATED, state)
    text = np.repeat(np.arange(len(sizes)), sizes)
    used = np.unique(text[state > 0])
    lo, hi = np.searchsorted(text, used), np.searchsorted(text, used, side="right")
    done, open_ = [], []
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        s, f, c = state[x:y], first[x:y].astype(np.int64), count[x:y].astype(np.int64)
        sure = (s == REPEATED) | (s == REFERENCE) | (s == COUNTED_REFERENCE)
        done.append(_spans(f[sure], c[sure]) if sure.any() else None)
        rest = s >= BORDER
        open_.append(np.stack([f[rest], c[rest], s[rest]], axis=1).astype(np.uint32).tobytes() if rest.any() else None)
    return pa.table({"node": pa.array(node[used], pa.int64()), "copies": pa.array(copies[used], pa.int64()),
                     "done": pa.array(done, pa.binary()), "open": pa.array(open_, pa.binary())})


# -- reference shards -------------------------------------------------------------------

def _wanted_texts(shared):
    """(node, text) of the wanted texts; each once a task."""
    def run(batches):
        wanted = None if shared is None else shared.value
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = batch.slice(lo, 256).column("text").cast(pa.binary()).to_pylist()
                out = []
                for node, text in zip((node_of(t) for t in texts), texts, strict=True):
                    if node not in seen and (wanted is None or _holds(wanted, node)):
                        if len(seen) >= 1 << 20:
                            seen.clear()
                        seen.add(node)
                        out.append((node, text))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()),
                                                      pa.array([t for _, t in out], pa.binary())], ["node", "body"])

    return run


def _holds(wanted: np.ndarray, node: int) -> bool:
    at = int(np.searchsorted(wanted, node))
    return at < len(wanted) and int(wanted[at]) == node


_OPEN = "anchor long, node long, copies long, first long, counted boolean, words binary"


def _open_runs(length: int):
    """The words of each open run; of counted ones, each window's hash."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                out: list[tuple] = []
                for node, copies, open_, text in zip(*(part.column(c).to_pylist() for c in
                                                       ("node", "copies", "open", "body")), strict=True):
                    words = WORDS.of(text.split())
                    grams = window_hashes(words, GRAM).view(np.int64)
                    order = grams.view(np.uint64)
                    windows = None
                    for first, count, state in np.frombuffer(open_, np.uint32).reshape(-1, 3).tolist():
                        span = order[first:first + length - GRAM + 1][::-1]
                        anchor = int(grams[first + length - GRAM - int(span.argmin())])
                        if state >= COUNTED:
                            if windows is None:
                                windows = window_hashes(words, length)
                            # a reference only counts (twice at least): its own windows are known to be repeated
                            whose, times = (node, copies) if state == COUNTED else (None, copies + 1)
                            out += [(anchor, whose, times, s, True, windows[s:s + 1].tobytes())
                                    for s in range(first, first + count)]
                        else:
                            out.append((anchor, node, copies, first, False,
                                        words[first:first + count + length - 1].tobytes()))
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = (pa.int64(),) * 4 + (pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                     [x.split()[0] for x in _OPEN.split(", ")])
        end_task()

    return run


class SuffixAutomaton:
    """All substrings of several word sequences; ``states[i]`` are the states of
    sequence i's prefixes, ``elsewhere(state)`` the length of the prefix's
    longest suffix that occurs at two places or more."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.states = [self._add(s) for s in sequences]
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]
        self._elsewhere = [0] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self._elsewhere[v] = self.length[v] if self.count[v] > 1 else self._elsewhere[self.link[v]]

    def _add(self, sequence: list[int]) -> list[int]:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last, out = 0, []
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:       # known prefix
                last = q
            else:
                made = None
                if q is None:
                    made = len(length)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    count.append(0)
                    p = last
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = made
                        p = link[p]
                    q = nxt[p][c] if p >= 0 else -1
                else:
                    p = last
                if q >= 0:
                    if length[q] == length[p] + 1:
                        target = q
                    else:
                        target = len(length)
                        nxt.append(dict(nxt[q]))
                        link.append(link[q])
                        length.append(length[p] + 1)
                        count.append(0)
                        link[q] = target
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = target
                            p = link[p]
                    if made is not None:
                        link[made] = target
                last = target if made is None else made
            count[last] += 1
            out.append(last)
        return out

    def elsewhere(self, state: int) -> int:
        return self._elsewhere[state]


def _match(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("anchor")
        anchors = table.column("anchor").to_numpy()
        cuts = np.flatnonzero(np.diff(anchors, prepend=anchors[0] - 1 if anchors[0] > -2 ** 63 else 0)).tolist()
        cuts = sorted({0, *cuts})
        columns = [table.column(c).to_pylist() for c in ("node", "first", "words")]
        nodes, spans = [], []
        for x, y in zip(cuts, [*cuts[1:], len(anchors)], strict=True):
            # copies of one run of one text may come from several tasks
            mine = {(columns[0][i], columns[1][i]): columns[2][i] for i in range(x, y)}
            if len(mine) < 2:
                continue
            machine = SuffixAutomaton([np.frombuffer(w, np.uint64).tolist() for w in mine.values()])
            best = machine._elsewhere
            for (node, first), states in zip(mine, machine.states, strict=True):
                found = [first + i for i, s in enumerate(states[length - 1:]) if best[s] >= length]
                if found:
                    starts = np.array(found)
                    nodes.append(node)
                    spans.append(_spans(starts, np.ones(len(starts), np.int64)))
        return pa.table({"node": pa.array(nodes, pa.int64()), "done": pa.array(spans, pa.binary())})

    return run


# -- removal ----------------------------------------------------------------------------

def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(node, done): for each text that has any, its repeated windows as packed
    intervals; a written table."""
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)
    settled = docs.mapInArrow(_send(parts, length), B.ROW).groupBy("part").applyInArrow(_settle, B.ROW)
    texts = materialise(settled.groupBy("block").applyInArrow(
        _by_text, "node long, copies long, done binary, open binary"))
    to_open = texts.filter("open IS NOT NULL").select("node", "copies", "open")
    bodies = docs.mapInArrow(_wanted_texts(_names(to_open)), "node long, body binary")
    opened = materialise(to_open.join(bodies, "node").mapInArrow(_open_runs(length), _OPEN))
    matched = (opened.filter("NOT counted").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(parts)))
               .groupBy("shard").applyInArrow(_match(length), "node long, done binary"))
    counted = opened.filter("counted").select("anchor", "node", "copies", "first", "words")
    often = (counted.groupBy("anchor", "words").agg(F.sum("copies").alias("times"))
             .filter("times > 1").select("anchor", "words"))
    starts = (counted.filter("node IS NOT NULL").join(often, ["anchor", "words"]).select("node", "first")
              .mapInArrow(_pack_starts, "node long, done binary"))
    sure = texts.filter("done IS NOT NULL").select("node", "done")
    each = sure.unionByName(matched).unionByName(starts).distinct()
    return materialise(each.groupBy("node").agg(F.array_sort(F.collect_set("done")).alias("done")))


def _pack_starts(batches):
    for batch in batches:
        first = batch.column("first").to_numpy().astype(np.uint32)
        packed = np.stack([first, first + np.uint32(1)], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in packed], pa.binary())],
                                         ["node", "done"])


def _names(table: DataFrame):
    """The table's texts as a broadcast sorted array, or None if they are too many."""
    names = materialise(table.select("node").distinct())
    if names.limit(MAX_NODES + 1).count() > MAX_NODES:
        return None
    return table.sparkSession.sparkContext.broadcast(np.sort(names.toArrow().column("node").to_numpy()))


def removed_words(n: int, done: list[bytes] | None, length: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    change = np.zeros(n + 1, np.int64)
    for spans in done or ():
        pairs = np.frombuffer(spans, np.uint32).reshape(-1, 2).astype(np.int64)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, np.minimum(pairs[:, 1] + length - 1, n), -1)
    return np.cumsum(change[:n]) > 0


def _mark(shared, text_at: int):
    """Adds the text's name and whether it has repeated windows."""
    def run(batches):
        wanted = None if shared is None else shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(text_at).cast(pa.binary()).to_pylist()
                nodes = [node_of(t or b"") for t in texts]
                hit = [wanted is None or _holds(wanted, n) for n in nodes]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.int64()), pa.array(hit, pa.bool_())],
                                                 [*part.schema.names, "__node", "__hit"])

    return run


def with_windows(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All columns and rows plus __done, the repeated windows of the text (or null).
    Texts without any are not shuffled."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("doc_id", F.lit(0).cast("long"))
    found = repeated_windows(docs.select("doc_id", "text"), length)
    shared = _names(found)
    schema = StructType([*df.schema.fields, StructField("__node", LongType()), StructField("__hit", BooleanType())])
    marked = df.mapInArrow(_mark(shared, df.columns.index(text_col)), schema)
    table = found.select(F.col("node").alias("__node"), F.col("done").alias("__done"))
    hit = marked.filter("__hit").join(table, "__node", "left")
    rest = marked.filter("NOT __hit").withColumn("__done", F.lit(None).cast("array<binary>"))
    return hit.select(*df.columns, "__done").unionByName(rest.select(*df.columns, "__done"))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that
    stay, joined by one space)."""
    rows = with_windows(text_rows(df, id_col, text_col), "text", length)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, gone, kept = [], [], []
                for text, done in zip(part.column("text").cast(pa.binary()).to_pylist(),
                                      part.column("__done").to_pylist(), strict=True):
                    words = text.split()
                    out = removed_words(len(words), done, length) if done else None
                    n.append(len(words))
                    gone.append(0 if out is None else int(out.sum()))
                    kept.append(b" ".join(words if out is None else
                                          [words[i] for i in np.flatnonzero(~out).tolist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: bytes, done: list[bytes], length: int) -> bytes:
    """The text without its covered words; each goes with the white space after it."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out = removed_words(len(spans), done, length)
    starts = [a for a, _ in spans] + [len(text)]
    pieces = [text[:starts[0]]] + [text[starts[i]:starts[i + 1]] for i in np.flatnonzero(~out).tolist()]
    return b"".join(pieces)


def cut_documents(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``df``, the text without its repeated passages."""
    own = [f"__c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    rows = with_windows(df.toDF(*own), own[at], length)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, done = part.column(at).to_pylist(), part.column("__done").to_pylist()
                cut = [cut_text(t.encode(), d, length).decode() if d else t for t, d in zip(texts, done, strict=True)]
                columns = part.columns[:-1]
                columns[at] = pa.array(cut, pa.string())
                yield pa.RecordBatch.from_arrays(columns, own)
        end_task()

    fields = [StructField(f.name, StringType()) if i == at else f for i, f in enumerate(rows.schema.fields[:-1])]
    return rows.mapInArrow(run, StructType(fields)).toDF(*df.columns)
