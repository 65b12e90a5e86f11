"""Language-model scoring with a weighted backoff automaton.

Model. Words are lower-cased (A-Z) runs of non-space bytes, and every text
ends with one end token. The n-grams that occur at least ``CUTOFF`` times in
the training texts are kept, at every input size: nothing bounds their number.

    P(w | h) = (c(hw) - d) / c(h) + bow(h) * P(w | h')     if hw is kept
             = bow(h) * P(w | h')                          else, h' being h without its first word
    P(w)     = (c(w) + 0.5) / (N + 0.5 * (V + 1))          for every word, kept or not
    bow(h)   = (c(h) - sum of (c(hw) - d) over the kept hw) / c(h)

so every state's probabilities add up to one. Kept contexts are states. An arc
(state, word) carries log10 P and leads to the longest suffix that is a state;
a failure arc carries log10 bow and leads from h to h'. Texts are traversed
from left to right, carrying the state and adding up the weights: a word
without an arc takes the failure arc and is tried again. Long texts are cut into
lanes; a lane starts ``order - 1`` words early, which is all a state can remember.

Work. The model stays in partitions; no task, and not the driver, holds more
of it than a partition. A block of documents (see ``blocks``) builds the automaton of its
own n-grams:

0. Each word of two occurrences or more gets a number from its partition, smaller ones for more frequent words.
1. Most n-grams occur once. A block sends a short hash of each of its n-grams, and learns
   in one bit whether it occurs twice in all. (A hash has eight bits more than the
   corpus has tokens need, so hardly any n-gram goes on by mistake, and none is missed.)
2. For each context it sends the count, and of the n-grams that go on their names and counts.
   The partition of a context adds up what follows it: c(h), the kept c(hw) and what bow(h) needs.
3. The block is answered with these, builds its states and arcs, and traverses its texts.

Documents are read again for steps 0, 1 and 2 rather than kept; step 3 reads what step 2 has shuffled. A block's rows must be
the same each time (a file scan's are; the numbers of words and of short hashes are compared). A context of a word so common that it would
fill a partition by itself is spread over several, by the names of what follows; the words that
need it, at most one per partition, are the only rows that the driver gets.

Words and n-grams of the first steps have names of 64 bits: two are taken for one with probability 2^-64 a pair. Kept
n-grams are named by the numbers of their words, which is exact while these have 64 bits at most; what follows a context,
by the number of one word.

Defined results: null text is empty (the end token alone); a null id is
trained on; equal rows each count; an empty training set scores by P alone.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.common import (WORDS, Words, give_back, mix64, order_names, shuffle_partitions, text_rows, unique_of,
                               window_hashes)
from quarry.session import materialise

CUTOFF = 2
DISCOUNT = 0.75
END = b" "          # no word holds a space
#: Tokens of a lane.
LANE = 512
#: Words of a partition that may be spread (of all words, fewer have a partition's share of the tokens
#: than there are partitions).
TOP = 64
#: Bytes of text in a block, about: its n-grams and their answers are several times as large.
BLOCK_BYTES = 9 << 20
#: Bits of a short hash beyond those of the number of training tokens.
SPARE_BITS = 8


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _tokens(text: bytes) -> list[bytes]:
    """The tokens of one text; ``_word_names`` names those of many."""
    words = text.lower().split()
    words.append(END)
    return words


def _word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(name of each token, tokens per text)."""
    words = Words(texts, lower=True)
    return words.with_ends(words.names(), WORDS[END]), words.per_text + 1


# -- packed numbers ---------------------------------------------------------------------

def _zip(x) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def _unzip(x: bytes):
    import zstandard
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _pack(values: np.ndarray) -> tuple:
    """Non-negative numbers as byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return len(values), width, values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(packed: tuple) -> np.ndarray:
    n, width, planes = packed
    values = np.zeros((n, 8), np.uint8)
    if n and width:
        values[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return values.view(np.uint64).reshape(n)


def _pack_names(names: np.ndarray) -> tuple:
    """Sorted distinct names: the first, and the gaps."""
    return (int(names[0]), _pack(np.diff(names))) if len(names) else (None, None)


def _unpack_names(packed: tuple) -> np.ndarray:
    first, gaps = packed
    if gaps is None:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), _unpack(gaps)]), dtype=np.uint64)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


def _part(names: np.ndarray, parts: int) -> np.ndarray:
    """Each name's partition: an equal range of the names."""
    return (((names >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _cuts(names: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's names start among the sorted ones."""
    return np.searchsorted(_part(names, parts), np.arange(parts + 1))


def _order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of small non-negative numbers: value and place are sorted as one number."""
    bits = np.uint64(len(values).bit_length())
    if not len(values) or int(values.max()) >> (64 - int(bits)):
        return np.argsort(values, kind="stable")
    both = (values.astype(np.uint64) << bits) | np.arange(len(values), dtype=np.uint64)
    both.sort()
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _by_use(names: np.ndarray, tokens: np.ndarray) -> tuple[list, np.ndarray]:
    """(the names packed in classes from the most used down, tokens numbered in that order): most
    numbers are small then, which packs to fewer bytes."""
    length = np.bincount(tokens, minlength=len(names))
    use = np.frexp(length.astype(np.float64))[1]                       # bits of the count
    order = _order(int(use.max(initial=0)) - use)
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    ends = np.flatnonzero(np.diff(use[order])) + 1
    return [_pack_names(x) for x in np.split(names[order], ends)], number[tokens]


# -- the n-grams of a block -------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers of so many bits, which makes their leading bits even."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for _ in range(2):
        x = x * _ODD & mask
        x ^= x >> half
    return x


class Block:
    """Texts as numbers of words, and the names of the n-grams that end at each token. ``ids``: the corpus-wide number
    of each word, of ``width`` bits at most, or -1; ``rare``: of words without a number, their training occurrences."""

    def __init__(self, names: np.ndarray, tokens: np.ndarray, lens: np.ndarray, held: np.ndarray, order: int,
                 ids: np.ndarray | None = None, rare: np.ndarray | None = None, width: int = 32):
        self.ids = (np.arange(len(names)) if ids is None else ids)[tokens]            # of each token
        self.rare, self.width = np.zeros(len(names), np.int64) if rare is None else rare, width
        self.names, self.tokens, self.lens, self.order = names, tokens.astype(np.int32), lens, order
        self.doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        self.nth = (np.arange(len(tokens)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        self.last = self.nth == lens[self.doc] - 1
        self.trained = ~held[self.doc]
        words = names[tokens]
        self.inside: list = [None, np.arange(len(tokens), dtype=np.int32)]       # [k]: tokens at which an n-gram of k words ends
        self.grams: list = [None, words]                         # [k]: its name
        for k in range(2, order + 1):
            inside = np.flatnonzero(self.nth >= k - 1).astype(np.int32)
            self.inside.append(inside)
            self.grams.append(window_hashes(words, k)[inside - (k - 1)])

    def numbered(self, k: int) -> np.ndarray:
        """Whether all words have numbers of the n-grams of order k."""
        at = self.inside[k]
        return np.logical_and.reduce([self.ids[at - j] >= 0 for j in range(k)])

    def bits(self, k: int) -> int:
        return min(64, k * self.width)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """The names of the n-grams of k words, which have numbers, that end at the tokens."""
        words = [self.ids[at - j].astype(np.uint64) for j in range(k - 1, -1, -1)]
        key = words[0]
        for word in words[1:]:
            key = key << np.uint64(self.width) | word if k * self.width <= 64 else mix64(key * _ODD + word)
        return _scramble(key, self.bits(k))

    def shorts(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct short hashes of order k, which of them each n-gram has)."""
        short = self.grams[k] >> np.uint64(64 - bits)
        return unique_of(short, _order(short))


def _left(names: np.ndarray, bits: int) -> np.ndarray:
    """Names of so many bits as names of 64, in the same order."""
    return names << np.uint64(64 - bits)


class Asked:
    """What a block asks about the contexts of k words, in a fixed order. ``context``: the names; ``at``: which
    context ends at each token, or -1; ``count``: training occurrences. Of what follows them, by context and
    name: ``of`` (the context), ``name`` (the word's number), ``times``, and ``where`` (a token at which it ends)."""

    def __init__(self, b: Block, k: int, goes_on: list):
        at, self.bits = b.inside[k], b.bits(k)
        use = ~b.last[at] & (b.numbered(1) if k == 1 else goes_on[k][at])
        names = b.keys(at[use], k)
        self.context, which = unique_of(names, order_names(_left(names, self.bits)))
        self.at = np.full(len(b.tokens), -1, np.int32)
        self.at[at[use]] = which
        self.count = np.bincount(which[b.trained[at[use]]], minlength=len(self.context))
        at = b.inside[k + 1]
        at = at[goes_on[k + 1][at] & (self.at[at - 1] >= 0)]
        of, names = self.at[at - 1], b.ids[at].astype(np.uint64)
        order = _order(of.astype(np.uint64) << np.uint64(b.width) | names)          # equal n-grams next to each other
        at, of, names = at[order], of[order], names[order]
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (of[1:] != of[:-1])]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.of, self.name, self.where = of[first], names[first], at[first]
        self.times = np.add.reduceat(b.trained[at].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        self.entry = np.full(len(b.tokens), -1, np.int32)           # which of these ends at each token
        self.entry[at] = np.cumsum(new) - 1


def _read(batches):
    """(block id, doc ids, held out, distinct word names, word numbers, tokens per document)."""
    for block, ids, texts in B.blocks(batches, True, BLOCK_BYTES):
        words, lens = _word_names(texts)
        del texts
        held = np.array([is_held_out(d) for d in ids])
        names, tokens = unique_of(words, order_names(words))
        yield block, ids, held, names, tokens, lens


# -- words ------------------------------------------------------------------------------

def _send_words(parts: int):
    """The block's distinct words and their training occurrences by partition; its training tokens and documents."""
    def rows(batches):
        for block, _, held, names, tokens, lens in _read(batches):
            trained = np.repeat(~held, lens)
            count = np.bincount(tokens[trained], minlength=len(names))
            cuts = _cuts(names, parts)
            yield block % parts, block, True, _zip((int(trained.sum()), int((~held).sum())))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[p], cuts[p + 1])
                yield p, block, False, _zip((_pack_names(names[mine]), _pack(count[mine])))

    return lambda batches: B.row_batches(rows(batches))


_COUNTED = B.ROW + ", n long, texts long, distinct long, numbered long, words array<long>, counts array<long>"


def _count_words(parts: int):
    """One row (docs) a partition: tokens, documents, distinct training words, words with numbers; and its TOP most frequent
    words with their counts. Answers each block: of its words, whether they occur in training, whether they have
    numbers, these (by which the partition and a number of its own are told), and the occurrences of the others."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        tokens = docs = 0
        sent = []
        for block, is_docs, payload in zip(*(table.column(c).to_pylist() for c in ("block", "docs", "payload")), strict=True):
            x = _unzip(payload)
            if is_docs:
                tokens, docs = tokens + x[0], docs + x[1]
            else:
                sent.append((block, _unpack_names(x[0]), _unpack(x[1])))
        every = np.concatenate([np.empty(0, np.uint64), *(x[1] for x in sent)])
        words, which = unique_of(every, order_names(every))
        total = np.bincount(which, weights=np.concatenate([np.empty(0), *(x[2] for x in sent)]), minlength=len(words)).astype(np.int64)
        by_use = np.argsort(-total, kind="stable")
        numbered = int((total >= CUTOFF).sum())
        number = np.empty(len(words), np.int64)
        number[by_use] = np.arange(len(words))
        top = by_use[:TOP]
        rows, lo = [], 0
        for block, names, _ in sent:
            at = which[lo:lo + len(names)]
            lo += len(names)
            n, often = total[at], total[at] >= CUTOFF
            rows.append((parts + part, block, False, _zip((len(at), np.packbits(n > 0).tobytes(), np.packbits(often).tobytes(),
                                                           _pack(number[at][often]), _pack(n[(n > 0) & ~often])))))
        answers = pa.Table.from_batches([B.batch_of([*rows, (part, -1, True, b"")])])
        more = {"n": tokens, "texts": docs, "distinct": int((total > 0).sum()), "numbered": numbered}
        for name, value in more.items():
            answers = answers.append_column(name, pa.array([None] * len(rows) + [value], pa.int64()))
        for name, value in (("words", words[top].view(np.int64)), ("counts", total[top])):
            answers = answers.append_column(name, pa.array([None] * len(rows) + [value.tolist()], pa.list_(pa.int64())))
        return answers

    return run


def _numbers(answers: list, names: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, occurrences of words without) of a block's words, from (partition, answer) in the order of the partitions."""
    ids, rare = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part, (n, seen, often, number, few) in answers:
        seen, often = _bits(seen, n), _bits(often, n)
        own, times = np.full(n, -1), np.zeros(n, np.int64)
        own[often] = _unpack(number).astype(np.int64) * parts + part
        times[seen & ~often] = _unpack(few).astype(np.int64)
        ids.append(own)
        rare.append(times)
    if sum(map(len, ids)) != len(names):
        raise RuntimeError("a block's documents differ from those of an earlier reading")
    order = order_names(names)
    out = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    out[0][order], out[1][order] = np.concatenate(ids), np.concatenate(rare)
    return out


class Shares:
    """How many partitions the contexts of common words are spread over."""

    def __init__(self, common: dict[int, int], n: int, parts: int):
        self.parts = parts
        self.names = np.array(sorted(common), np.uint64)
        self.share = np.array([common[x] / max(n, 1) for x in sorted(common)])

    def of(self, names: np.ndarray) -> np.ndarray:
        """Each word's share of the tokens; 0 if it is not common."""
        if not len(self.names):
            return np.zeros(len(names))
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.share[at], 0.0)

    def spread(self, b: Block, asked: Asked, k: int) -> np.ndarray:
        """For each context, over how many partitions it is spread: by the share of its words, taken
        as if they were independent, times four for each word but the first, which they are not."""
        where = np.zeros(len(asked.context), np.int64)
        held = np.flatnonzero(asked.at >= 0)
        where[asked.at[held]] = held
        share = np.ones(len(where))
        words = self.of(b.names)
        for i in range(k):
            share *= words[b.tokens[where - i]] * (4 if i else 1)
        return np.maximum(1, np.ceil(np.minimum(share, 1.0) * self.parts)).astype(np.int64)


# -- 1: which n-grams occur twice -------------------------------------------------------

def _send_shorts(order: int, parts: int, bits: int):
    def rows(batches):
        for block, _, held, names, tokens, lens in _read(batches):
            b = Block(names, tokens, lens, held, order)
            found = []
            for k in range(2, order + 1):
                short, which = b.shorts(k, bits)
                count = np.bincount(which[b.trained[b.inside[k]]], minlength=len(short))
                found.append((short, count, _cuts(short << np.uint64(64 - bits), parts)))
            for p in range(parts):
                mine = [slice(c[p], c[p + 1]) for _, _, c in found]
                if all(m.start == m.stop for m in mine):
                    continue
                yield p, block, False, _zip([(_pack_names(s[m]), np.packbits(c[m] > 0).tobytes(), np.packbits(c[m] > 1).tobytes())
                                             for (s, c, _), m in zip(found, mine, strict=True)])

    return lambda batches: B.row_batches(rows(batches))


def _seen_twice(table: pa.Table) -> pa.Table:
    """Answers each block with a bit for each short hash."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("part", "block", "payload")), strict=True))
    sent = [_unzip(x) for _, _, x in rows]
    answers: list[list] = [[] for _ in sent]
    for k in range(len(sent[0])):
        names = [_unpack_names(x[k][0]) for x in sent]
        often = [_bits(x[k][1], len(s)).astype(np.int64) + _bits(x[k][2], len(s)) for x, s in zip(sent, names, strict=True)]
        every = np.concatenate(names)
        distinct, which = unique_of(every, _order(every))
        twice = (np.bincount(which, weights=np.concatenate(often), minlength=len(distinct)) >= 2)[which]
        ends = np.cumsum([len(s) for s in names])
        for answer, lo, hi in zip(answers, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            answer.append((hi - lo, np.packbits(twice[lo:hi]).tobytes()))
    return pa.Table.from_batches([B.batch_of([(p, b, False, _zip(a)) for (p, b, _), a in zip(rows, answers, strict=True)])])


# -- 2: contexts and what follows them --------------------------------------------------

def _send_docs(batches):
    """The block's documents; part -1."""
    def rows():
        for block, ids, held, names, tokens, lens in _read(batches):
            classes, numbers = _by_use(names, tokens)
            yield -1, block, True, _zip((ids, held, lens, classes, _pack(numbers)))

    return B.row_batches(rows(), 1)


def _open(table: pa.Table, order: int, bits: int, parts: int, width: int):
    """(doc ids, held out, Block, Asked of each order, payloads of answers in order of their parts) of one block's rows."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("part", "docs", "payload")), strict=True))
    ids, held, lens, classes, tokens = _unzip(next(x for _, docs, x in rows if docs))
    names = np.concatenate([_unpack_names(x) for x in classes])
    answers = sorted(((p, _unzip(x)) for p, docs, x in rows if not docs), key=lambda r: r[0])
    # Answers about short hashes come from parts 0 on, those about words from ``parts`` on, those about contexts from below -1.
    ids_of, rare = _numbers([(p - parts, x) for p, x in answers if p >= parts], names, parts)
    b = Block(names, _unpack(tokens).astype(np.int64), lens, held, order, ids_of, rare, width)
    shorts = [x for p, x in answers if 0 <= p < parts]
    goes_on = [None, None]
    for k in range(2, order + 1):
        short, which = b.shorts(k, bits)
        twice = np.concatenate([_bits(x[k - 2][1], x[k - 2][0]) for x in shorts] or [np.zeros(0, bool)])
        if len(twice) != len(short):
            raise RuntimeError("a block's documents differ from those of an earlier reading")
        flags = np.zeros(len(b.tokens), bool)
        flags[b.inside[k]] = twice[which] & b.numbered(k)
        goes_on.append(flags)
    asked = [None] + [Asked(b, k, goes_on) for k in range(1, order)]
    return ids, held, b, asked, [(-2 - p, x) for p, x in reversed(answers) if p < -1]


def _requests(b: Block, asked: Asked, k: int, shares: Shares) -> tuple:
    """(part, context, whether it is the first of its context's partitions) of each context entry, by
    part and context; (part, entry number) of each n-gram that follows. Both in a fixed order."""
    home, spread = _part(_left(asked.context, asked.bits), shares.parts), shares.spread(b, asked, k)
    context = np.repeat(np.arange(len(home)), spread)
    slot = np.arange(len(context)) - np.repeat(np.cumsum(spread) - spread, spread)
    part = (home[context] + slot) % shares.parts
    order = _order(part)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    own = (mix64(asked.name) % spread[asked.of].astype(np.uint64)).astype(np.int64)
    entry = place[(np.cumsum(spread) - spread)[asked.of] + own]
    return part[order], context[order], slot[order] == 0, entry


def _ask(order: int, bits: int, width: int, shares):
    """Sends a block's contexts and what follows them by partition."""
    def run(table: pa.Table) -> pa.Table:
        _, _, b, asked, _ = _open(table, order, bits, shares.value.parts, width)
        block = table.column("block")[0].as_py()
        by_part: list[list] = [[] for _ in range(shares.value.parts)]
        for k in range(1, order):
            a = asked[k]
            part, context, first, entry = _requests(b, a, k, shares.value)
            follow = _order(entry)
            cuts = np.searchsorted(part, np.arange(shares.value.parts + 1))
            ends = np.searchsorted(entry[follow], cuts)
            number = np.bincount(entry, minlength=len(part))
            for p in range(shares.value.parts):
                mine, those = slice(cuts[p], cuts[p + 1]), follow[ends[p]:ends[p + 1]]
                by_part[p].append((_pack_names(a.context[context[mine]]), _pack(np.where(first, a.count[context], 0)[mine]),
                                   _pack(number[mine]), _pack(a.name[those]), _pack(a.times[those])))
        del b, asked, a
        give_back()
        return pa.Table.from_batches([B.batch_of([(p, block, False, _zip(x)) for p, x in enumerate(by_part)
                                                  if any(y[0][1] is not None for y in x)])])

    return run


def _total(width: int):
    """Answers each block: of each context entry c(h), the kept counts in all and their number; of
    what follows, the whole counts (only of the kept)."""
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("part", "block", "payload")), strict=True))
        sent = [_unzip(x) for _, _, x in rows]
        answers: list[list] = [[] for _ in sent]
        for k in range(len(sent[0])):
            contexts = [_unpack_names(x[k][0]) for x in sent]
            counts, numbers, names, times = (np.concatenate([_unpack(x[k][i]) for x in sent]) for i in range(1, 5))
            h = np.concatenate(contexts)
            h, which = unique_of(h, order_names(_left(h, min(64, (k + 1) * width))))
            c = np.bincount(which, weights=counts, minlength=len(h)).astype(np.int64)
            of = np.repeat(which, numbers.astype(np.int64))
            order = _order(of.astype(np.uint64) << np.uint64(width) | names)
            new = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (of[order][1:] != of[order][:-1])]) \
                if len(order) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            total = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            kept = total >= CUTOFF
            mine = of[order][first][kept]
            sums = np.bincount(mine, weights=total[kept], minlength=len(h)).astype(np.int64)
            number = np.bincount(mine, minlength=len(h))
            whole = np.empty(len(order), np.int64)
            whole[order] = np.where(kept, total, 0)[np.cumsum(new) - 1] if len(order) else 0
            ends, f_ends = np.cumsum([len(x) for x in contexts]), np.cumsum([x[k][3][0] for x in sent])
            for answer, lo, hi, f_lo, f_hi in zip(answers, [0, *ends[:-1].tolist()], ends.tolist(), [0, *f_ends[:-1].tolist()],
                                                  f_ends.tolist(), strict=True):
                at, f = which[lo:hi], whole[f_lo:f_hi]
                answer.append((_pack(c[at]), _pack(sums[at]), _pack(number[at]), (len(f), np.packbits(f > 0).tobytes()), _pack(f[f > 0])))
        return pa.Table.from_batches([B.batch_of([(-2 - p, b, False, _zip(a)) for (p, b, _), a in zip(rows, answers, strict=True)])])

    return run


# -- 3: the automaton -------------------------------------------------------------------

class Automaton:
    """Numbered states; the last one is the root. ``arcs``: sorted (state * words + word), with weight
    and target; ``fail``: of each state, weight and target; ``root``: of each word, weight and target."""

    def __init__(self, words: int, arcs: np.ndarray, arc_weight: np.ndarray, arc_to: np.ndarray, fail_weight: np.ndarray,
                 fail_to: np.ndarray, root_weight: np.ndarray, root_to: np.ndarray):
        order = np.argsort(arcs)
        self.words, self.arcs, self.arc_weight, self.arc_to = words, arcs[order], arc_weight[order], arc_to[order]
        self.fail_weight, self.fail_to, self.root_weight, self.root_to = fail_weight, fail_to, root_weight, root_to
        self.root = len(fail_to)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, weights) of reading one word in each state."""
        state, weight = state.copy(), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            s, w = state[open_], word[open_]
            at_root = s == self.root
            done = open_[at_root]
            weight[done] += self.root_weight[w[at_root]]
            state[done] = self.root_to[w[at_root]]
            open_, s, w = open_[~at_root], s[~at_root], w[~at_root]
            key = s * self.words + w
            at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
            weight[open_[hit]] += self.arc_weight[at[hit]]
            state[open_[hit]] = self.arc_to[at[hit]]
            open_, s = open_[~hit], s[~hit]
            weight[open_] += self.fail_weight[s]
            state[open_] = self.fail_to[s]
        return state, weight

    def scores(self, tokens: np.ndarray, lens: np.ndarray, memory: int) -> np.ndarray:
        """The weight of each text, read in lanes that start ``memory`` words early."""
        ends = np.cumsum(lens)
        lanes = -(-lens // LANE)
        doc = np.repeat(np.arange(len(lens)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (ends - lens)[doc] + nth * LANE
        start = np.maximum(begin - memory, (ends - lens)[doc])
        stop = np.minimum(begin + LANE, ends[doc])
        order = np.argsort(start - stop, kind="stable")          # the longest first
        doc, begin, start, stop = doc[order], begin[order], start[order], stop[order]
        state, total = np.full(len(doc), self.root), np.zeros(len(doc))
        length = stop - start
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, side="left"))   # lanes of more than t words
            state[:n], weight = self.step(state[:n], tokens[start[:n] + t])
            total[:n] += np.where(start[:n] + t >= begin[:n], weight, 0.0)
        return np.bincount(doc, weights=total, minlength=len(lens))


def build(b: Block, asked: list, answers: list, ends: int, space: float) -> tuple[Automaton, np.ndarray]:
    """(the automaton of a block's n-grams, the count of each of its words); ``answers``: of each order
    (c(h), kept sums, kept numbers) per context and whole counts per n-gram; ``ends``: training texts."""
    words = len(b.names)
    count = b.rare.copy()
    end = b.tokens[b.last]
    count[end] = ends
    first = np.flatnonzero(asked[1].at >= 0)
    count[b.tokens[first]] = answers[0][0][asked[1].at[first]]
    lower = np.log10((count + 0.5) / space)                       # log P(w)
    # states: kept contexts, by order; the root last
    number, n_states = [None], 0
    for c, *_ in answers:
        kept = c >= CUTOFF
        number.append(np.where(kept, np.cumsum(kept) - 1 + n_states, -1))
        n_states += int(kept.sum())
    fail_weight, fail_to = np.zeros(n_states), np.full(n_states, n_states)

    def state_at(token: np.ndarray, k: int) -> np.ndarray:
        """The state of the longest suffix of at most k words that ends at each token."""
        if k == 0:
            return np.full(len(token), n_states)
        context = asked[k].at[token]
        own = np.where(context >= 0, number[k][context], -1) if len(number[k]) else np.full(len(token), -1)
        return np.where(own >= 0, own, state_at(token, k - 1))

    prob: list = [None]                                           # [k]: P of each n-gram of k + 1 words that was asked for
    keys, weights, targets = [], [], []
    for k in range(1, len(asked)):
        a, (c, sums, kinds, whole) = asked[k], answers[k - 1]
        bow = (c - sums + DISCOUNT * kinds) / np.maximum(c, 1)
        where = np.zeros(len(a.context), np.int64)
        held = np.flatnonzero(a.at >= 0)
        where[a.at[held]] = held
        mine = number[k] >= 0
        fail_weight[number[k][mine]] = np.log10(bow[mine])
        fail_to[number[k][mine]] = state_at(where[mine], k - 1)
        # P(w | h'): of the shorter n-gram if it was asked for, else its own way down
        word = b.tokens[a.where]
        p = 10 ** lower[word]
        for j in range(1, k):                                     # from the shortest context of two tokens or more up
            shorter = asked[j].entry[a.where]
            context = asked[j].at[a.where - 1]
            cj, sj, kj, _ = answers[j - 1]
            state = (context >= 0) & (cj[context] >= CUTOFF) if len(cj) else np.zeros(len(p), bool)
            bj = np.where(state, (cj[context] - sj[context] + DISCOUNT * kj[context]) / np.maximum(cj[context], 1), 1.0) \
                if len(cj) else np.ones(len(p))
            known = (shorter >= 0) & (prob[j][shorter] > 0) if len(prob[j]) else np.zeros(len(p), bool)
            p = np.where(known, prob[j][shorter] if len(prob[j]) else 0.0, bj * p)
        of_count = c[a.of]
        arc = (whole >= CUTOFF) & (of_count >= CUTOFF)
        own = np.where(arc, (whole - DISCOUNT) / np.maximum(of_count, 1) + bow[a.of] * p, 0.0)
        prob.append(own)
        keys.append(number[k][a.of[arc]] * words + word[arc])
        weights.append(np.log10(own[arc]))
        targets.append(state_at(a.where[arc], min(k + 1, len(asked) - 1)))
    root_to = np.full(words, n_states)
    root_to[b.tokens[first]] = state_at(first, 1)
    return Automaton(words, np.concatenate(keys), np.concatenate(weights), np.concatenate(targets), fail_weight, fail_to,
                     lower, root_to), count


def _answers_of(b: Block, asked: list, received: list, shares: Shares) -> list:
    """The partitions' answers put together, per order: c(h), kept sums and numbers by context, whole counts by n-gram."""
    out = []
    for k in range(1, len(asked)):
        a = asked[k]
        _, context, _, entry = _requests(b, a, k, shares)
        got = [[_unpack(x[k - 1][i]).astype(np.int64) for _, x in received] for i in range(3)]
        per = [np.concatenate([np.zeros(0, np.int64), *g]) for g in got]
        whole = [np.zeros(0, np.int64)]
        for _, x in received:
            n, bits = x[k - 1][3]
            f = np.zeros(n, np.int64)
            f[_bits(bits, n)] = _unpack(x[k - 1][4]).astype(np.int64)
            whole.append(f)
        follow = _order(entry)
        total = np.zeros(len(follow), np.int64)
        total[follow] = np.concatenate(whole)
        out.append((*(np.bincount(context, weights=v, minlength=len(a.context)).astype(np.int64) for v in per), total))
    return out


def _traverse(order: int, bits: int, width: int, shares, n: int, ends: int, space: float):
    def run(known: pa.Table, totals: pa.Table) -> pa.Table:
        ids, held, b, asked, received = _open(pa.concat_tables([known, totals]), order, bits, shares.value.parts, width)
        automaton, count = build(b, asked, _answers_of(b, asked, received, shares.value), ends, space)
        score = automaton.scores(b.tokens, b.lens, order - 1)
        del automaton, asked, received
        give_back()
        sums = lambda x: np.bincount(b.doc, weights=x, minlength=len(b.lens))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held),
                         "n_tokens": pa.array(b.lens, pa.int64()),
                         "n_known": pa.array(sums(count[b.tokens] > 0).astype(np.int64), pa.int64()),
                         "train_tokens": pa.array([n] * len(ids), pa.int64()),
                         "base_score": pa.array(sums(np.log10((count[b.tokens] + 0.5) / space))), "score": pa.array(score)})

    return run


# -- scoring ----------------------------------------------------------------------------

def score(df: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the rows that are not held out and scores every row: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score. ``order`` is two at least."""
    spark = df.sparkSession
    docs = text_rows(df, id_col, text_col)
    parts = 4 * shuffle_partitions(spark)
    counted = materialise(docs.mapInArrow(_send_words(parts), B.ROW).groupBy("part").applyInArrow(_count_words(parts), _COUNTED))
    words = counted.filter("docs")
    n, ends, v, most = words.agg(*[F.coalesce(f(c), F.lit(0)) for f, c in (
        (F.sum, "n"), (F.sum, "texts"), (F.sum, "distinct"), (F.max, "numbered"))]).first()
    space = n + 0.5 * (v + 1)
    width = max(most * parts, 1).bit_length()
    # words with more than a partition's share of the tokens: ``parts`` of them at most
    common = (words.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).filter(F.col("w.counts") * parts > n)
              .select("w.words", "w.counts").collect())
    shares = spark.sparkContext.broadcast(Shares({r[0] % (1 << 64): r[1] for r in common}, n, parts))
    bits = min(64, max(n, 1).bit_length() + SPARE_BITS)
    # a bit an n-gram
    twice = materialise(docs.mapInArrow(_send_shorts(order, parts, bits), B.ROW).groupBy("part").applyInArrow(_seen_twice, B.ROW))
    numbers = counted.filter("NOT docs").select("part", "block", "docs", "payload")
    known = docs.mapInArrow(_send_docs, B.ROW).unionByName(twice).unionByName(numbers)
    asked = known.groupBy("block").applyInArrow(_ask(order, bits, width, shares), B.ROW)
    totals = asked.groupBy("part").applyInArrow(_total(width), B.ROW)
    # The blocks' rows are shuffled once: Spark reuses the exchange.
    return (known.groupBy("block").cogroup(totals.groupBy("block"))
            .applyInArrow(_traverse(order, bits, width, shares, n, ends, space),
                          "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                          "base_score double, score double"))
