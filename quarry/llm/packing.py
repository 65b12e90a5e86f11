"""Sequence packing by power-of-two decomposition.

A document's n token ids are cut into pieces of 2048 tokens followed by the
binary decomposition of what remains (1024, 512, ... 1). Pieces of equal
length form a bucket, and every piece is a sequence of its own: no sequence
crosses documents, and because a sequence may have any power of two up to
2048, none needs padding. A batch is drawn from one bucket.

Sequence ids are gapless and ordered by bucket: the pieces' counts per
(bucket, piece of the written table) give each run of pieces its first id.

Word pieces come from the tokenizer's own library, or from its merges for runs of letters, once per distinct
word between ASCII white space of some megabytes of text and of a worker's bounded table: its pattern never
matches white space and its normaliser never composes across it, so a text's
ids are its words' ids one after the other. Words are found, told
apart, looked up and replaced by their ids as arrays, the table too, at some 50 bytes a word;
a word is one of the table only if all its bytes are equal. Special strings inside a text
are handled inside their word as the library does by default.

Defined results: null text is empty (a document of the end id alone); equal
rows are packed one by one; ids may be null or repeated; no rows, no pieces.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Runs, Words, give_back, only_cache, order_names, text_rows, unique_of
from quarry.session import materialise

MAX_LENGTH = 2048
#: Bytes of text whose words are looked up together, about: their arrays are some 30 times as large.
SLICE_BYTES = 1 << 19
#: Rows whose ids are held together.
SLICE_ROWS = 250
#: Words of a worker's table.
TABLE_WORDS = 1 << 19


def piece_lengths(n: int, limit: int = MAX_LENGTH) -> list[int]:
    """Powers of two up to ``limit`` that add up to n, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes are numbered from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


def letter_encoder(path: str):
    """The file's merges as rank merges (tiktoken) for runs of lower-case letters, some times faster for one run; None
    unless the ids are in the order of the merges, since only then the two agree.

    A word's last byte is a symbol of its own (with the end-of-word suffix): it is written as a byte that such runs do not
    hold, a letter's capital or a continuation byte less 128."""
    import json

    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, vocab = model["end_of_word_suffix"], model["vocab"]
    order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if not suffix or model["dropout"] or order != sorted(order) or len(vocab) != 512 + len(order) or min(order) < 512:
        return None
    char_bytes = {chr(c): b for b, c in BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in BYTE_CHARS}
    ranks = {}
    for token, i in vocab.items():
        ended = token.endswith(suffix)
        run = bytes(char_bytes[c] for c in (token[:-len(suffix)] if ended else token))
        if all(c >= 128 or 97 <= c <= 122 for c in run) and not (ended and run[-1] >= 192):
            ranks[run[:-1] + LAST[run[-1]] if ended else run] = i
    return tiktoken.Encoding("letters", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})


#: The last byte of a run of letters, as ``letter_encoder`` writes it.
LAST = [bytes([b - 128 if 128 <= b < 192 else b - 32 if 97 <= b <= 122 else b]) for b in range(256)]
MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit bytes, from the library; bounded: of ``limit`` words, those
    looked up since it was last half full are kept."""

    def __init__(self, path: str, limit: int = 1 << 20, longest: int = 64):
        super().__init__()
        self.old: dict[bytes, bytes] = {}
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalise, self.tokenize = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.letters = letter_encoder(path)
        self.limit, self.longest = limit, longest

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def _encode(self, word: bytes) -> bytes:
        """A run of letters is one match of the pattern, so the merges take
        it directly, normalised and in byte characters; ASCII marks after a run of
        letters are a match of their own; anything else takes the library's whole path."""
        if word.isalpha():
            return self._letters(word.lower())
        text = word.decode()
        if text.isalpha():
            small = self.normalise(text)
            if small.isalpha():
                return self._letters(small.encode())
        elif word[-1:] in MARKS:
            stem = word.rstrip(MARKS)
            if text[:len(stem) - len(word)].isalpha():
                return self[stem] + self[word[len(stem):]]
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, run: bytes) -> bytes:
        if self.letters:
            return _packed(self.letters._encode_single_piece(run[:-1] + LAST[run[-1]]))
        return _packed([t.id for t in self.tokenize(run.decode("latin-1").translate(BYTE_CHARS))])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(word) <= self.longest:
            if 2 * len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class Generation:
    """Words by name, with their bytes and ids, as arrays. Of words of one name the first stays."""

    def __init__(self):
        self.names, self.rows = np.empty(0, np.uint64), np.empty(0, np.int32)         # by name; the row of each
        self.words = Runs(np.zeros(8, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
        self.ids, self.first, self.size = np.empty(0, "<u4"), np.empty(0, np.int32), np.empty(0, np.int32)

    def find(self, names: np.ndarray, words: Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row or -1 of each word, where its name belongs, whether its name is there) of words in the order of their names."""
        at = np.searchsorted(self.names, names)
        row = np.full(len(names), -1, np.int64)
        if not len(self.names):
            return row, at, np.zeros(len(names), bool)
        there = self.names[np.minimum(at, len(self.names) - 1)] == names
        maybe = np.flatnonzero(there)
        found = self.rows[at[maybe]]
        same = words.same(which[maybe], self.words, found)
        row[maybe[same]] = found[same]
        return row, at, there

    def add(self, names: np.ndarray, at: np.ndarray, words: Runs, which: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        start, length, n = words.start[which], words.length[which], len(self.names)
        used = len(self.words.data) - 8
        data = np.concatenate([self.words.data[:used], np.frombuffer(words.data, np.uint8)[_runs(start, length)], np.zeros(8, np.uint8)])
        self.words = Runs(data, np.append(self.words.start, (used + np.cumsum(length) - length).astype(np.int32)).astype(np.int32),
                          np.append(self.words.length, length).astype(np.int32))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size).astype(np.int32)
        self.size, self.ids = np.append(self.size, size).astype(np.int32), np.append(self.ids, ids)
        self.names = np.insert(self.names, at, names)
        self.rows = np.insert(self.rows, at, np.arange(n, n + len(names), dtype=np.int32))


class WordTable:
    """The ids of words met, as arrays; bounded: of ``limit`` words, those looked up since it was last half full are kept."""

    def __init__(self, limit: int = TABLE_WORDS, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.forget()

    def forget(self) -> None:
        self.new, self.old = Generation(), Generation()

    def __len__(self) -> int:
        return len(self.new.names) + len(self.old.names)

    def ids(self, cache, words: Words, which: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids of each) of words in the order of their names; ``cache`` has those not met."""
        row, at, there = self.new.find(names, words, which)
        rest = np.flatnonzero(row < 0)
        old_row = np.full(len(row), -1, np.int64)
        old_row[rest] = self.old.find(names[rest], words, which[rest])[0]
        missing = rest[old_row[rest] < 0]
        asked = [cache[words.data[a:a + n]] for a, n in zip(words.start[which[missing]].tolist(), words.length[which[missing]].tolist(),
                                                            strict=True)]
        sources = [(self.new, row), (self.old, old_row)]
        size = np.zeros(len(row), np.int64)
        size[missing] = np.fromiter(map(len, asked), np.int64, len(asked)) // 4
        for source, rows in sources:
            size[rows >= 0] = source.size[rows[rows >= 0]]
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), "<u4")
        out[_runs(first[missing], size[missing])] = np.frombuffer(b"".join(asked), "<u4")
        for source, rows in sources:
            mine = rows >= 0
            out[_runs(first[mine], size[mine])] = source.ids[_runs(source.first[rows[mine]], size[mine])]
        more = rest[~there[rest] & (words.length[which[rest]] <= self.longest)]
        if 2 * (len(self.new.names) + len(more)) > self.limit:
            self.old, self.new, at = self.new, Generation(), np.zeros(len(at), np.int64)
            more = more[:self.limit // 2]
        self.new.add(names[more], at[more], words, which[more], out[_runs(first[more], size[more])], size[more])
        return out, size


_CACHES: dict[str, tuple[WordIds, WordTable]] = {}


def word_ids(path: str) -> tuple[WordIds, WordTable]:
    """The worker's cache (of words just asked for, and stems) and table for one tokenizer file."""
    only_cache(_CACHES.clear)
    if path not in _CACHES:
        _CACHES[path] = WordIds(path, 1 << 15), WordTable()
    return _CACHES[path]


def _first_of_each(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the number of one word of each name, which of these has the name of each word)."""
    order = order_names(names)
    _, which = unique_of(names, order)
    one = np.empty(int(which.max(initial=-1)) + 1, np.int64)
    one[which] = np.arange(len(which))
    return one, which


def encode_texts(cache, texts: list[bytes], end: bytes, table: WordTable | None = None) -> list[bytes]:
    """The ids of each text, ``end`` (at most one id) last. Words are cut at ASCII white space; one that holds
    other white space takes the library's whole path. Words that ``table`` has are not asked of ``cache``."""
    if not texts:
        return []
    words = Words(texts)
    names = words.names()
    one, which = _first_of_each(names)
    if not words.equal(one[which]):                   # two words of one hash
        one, which, table = np.arange(len(which)), np.arange(len(which)), None
    if table is not None:
        known, size = table.ids(cache, words, one, names[one])
    else:
        spans = zip(words.start[one].tolist(), (words.start + words.length)[one].tolist(), strict=True)
        data = words.data
        found = [*map(cache.__getitem__, [data[a:b] for a, b in spans])]
        known, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
    known, size = np.append(known, np.frombuffer(end, "<u4")), np.append(size, len(end) // 4)
    first = np.cumsum(size) - size
    token = words.with_ends(which, len(one))
    n = size[token]
    ids = known[_runs(first[token], n)].tobytes()
    ends = [0, *(4 * np.cumsum(n)[np.cumsum(words.per_text + 1) - 1]).tolist()]
    return [ids[a:b] for a, b in itertools.pairwise(ends)]


def _slices(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The texts in runs of about ``most`` bytes; a longer one is a run alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _tokenise(path: str, end_id: int | None):
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        cache, table = word_ids(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part, out = batch.slice(lo, SLICE_ROWS), []
                for texts in _slices(part.column("text").cast(pa.binary()).to_pylist(), SLICE_BYTES):
                    out += encode_texts(cache, texts, end, table)
                found = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.large_binary())], ["doc_id", "ids"])
                del part, out, texts
                yield found
            give_back()
        cache.forget()
        table.forget()
        give_back()

    return run


def token_ids(df: DataFrame, path: str, end_id: int | None = 1, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit), ``end_id`` last."""
    return text_rows(df, id_col, text_col).mapInArrow(_tokenise(path, end_id), "doc_id long, ids binary")


_PIECE = ("doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, "
          "part int, nth long")


def _cut(limit: int, with_ids: bool = True):
    def run(batches):
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, limit):
                    piece = ids[4 * start:4 * (start + length)]
                    rows.append((doc, start, length, n, zlib.crc32(piece), piece if with_ids else None, part,
                                 seen[length]))
                    seen[length] += 1
                    start += length
            kinds = (pa.int64(),) * 5 + (pa.large_binary(), pa.int32(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             [c.split()[0] for c in _PIECE.split(", ")])

    return run


def pieces(tokens: DataFrame, limit: int = MAX_LENGTH) -> DataFrame:
    """The pieces of (doc_id, ids) rows: doc_id, start, length, doc_tokens,
    ids_crc32, ids; part and nth place a piece among those of its length."""
    return tokens.mapInArrow(_cut(limit), _PIECE)


def number_sequences(cut: DataFrame) -> DataFrame:
    """Replaces part and nth by sequence_id (gapless from 0, bucket by bucket,
    longest first) and offset 0. ``cut`` must be a written table, so that the
    numbers stay the same however often it is read. Pieces are not shuffled:
    the first ids are one row per length and part, at most 12 a partition."""
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_id"))
    return (cut.join(F.broadcast(first), ["length", "part"])
            .withColumn("sequence_id", (F.col("first_id") + F.col("nth")).cast("long"))
            .withColumn("offset", F.lit(0).cast("long"))
            .drop("part", "nth", "first_id"))


def pack(df: DataFrame, path: str, end_id: int = 1, limit: int = MAX_LENGTH, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id,
    offset. The ids themselves are in ``pieces(token_ids(...))``, which the
    sequence ids join by (doc_id, start)."""
    tokenise, cut = _tokenise(path, end_id), _cut(limit, with_ids=False)
    rows = text_rows(df, id_col, text_col).mapInArrow(lambda batches: cut(tokenise(batches)), _PIECE)
    out = number_sequences(materialise(rows.drop("ids")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
