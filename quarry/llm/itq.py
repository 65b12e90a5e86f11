"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the centred principal components is learned on a bounded sample
so that the signs of the rotated vectors lose as little as possible (iterative
quantisation). The signs are a 64-bit code. The code is cut into chunks; each
chunk has a table keyed by its value, which is probed with a chunk's value and
all values within a radius of it. Candidates whose codes differ in at most so many bits are
reranked with the original vectors, in double precision.

Chunks, radius and bits follow from the data: each sample vector gets a partner at exactly the
threshold, in the direction of another one, and the first of ``TABLES`` that brings
``RECALL`` of them together is taken (four chunks of sixteen bits and radius one where vectors
point everywhere; where they have a direction in common, near ones differ in more bits of the
centred code, and smaller chunks or a larger radius find them).

Only vectors with equal, non-null labels are compared. Equal vectors are one
node. Nodes of one code are a cell, cut into blocks of about ``BLOCK``; the
tables hold cells, and a pair of blocks is compared by one matrix product in
one task, which returns a count and one link per node and never the pairs.
So a large group of near copies costs rows in proportion to its blocks.

Bounds: the rotation is fitted on at most ``SAMPLE`` vectors (the smallest by
a hash of the id); it only steers recall. Every vector is indexed.

Defined results: a vector that is null or zero, or holds null or non-finite
components, and one without a label link with nothing; vectors of different lengths never
link; equal rows are vectors of their own (linked with each other); a null id
is a row like others, its component is the smallest id that is not null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small
from quarry.llm.components import connected_components
from quarry.session import materialise

BITS = 64
#: Bits of a chunk and radius of the probes, the cheapest first.
TABLES = [(16, 1), (16, 2), (8, 1), (8, 2)]
SAMPLE = 20_000
#: Share of the sample's partners that must be found, and bits in which codes may differ at least.
RECALL, LEAST_BITS = 0.97, 16
BLOCK = 256
THRESHOLD = 0.98


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector scaled to length one in double precision, or None if it
    cannot be compared."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid or x.values.null_count:
            out.append(None)
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max() if len(v) else 0.0
        if not np.isfinite(top) or top == 0.0:
            out.append(None)
            continue
        v = v / top
        out.append(v / np.sqrt(v @ v))
    return out


class Quantiser:
    """Codes of unit vectors: signs of (v - mean) @ projection."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 1):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1]
        if d < bits:       # more bits than directions: random further ones
            axes = np.concatenate([axes, rng.standard_normal((d, bits - d))], axis=1)
        axes = axes[:, :bits]
        v = x @ axes
        rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(rounds):
            signs = np.where(v @ rotation >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(signs.T @ v)
            rotation = (u @ w).T
        self.projection = axes @ rotation

    def codes(self, x: np.ndarray) -> np.ndarray:
        d = len(self.mean)
        if x.shape[1] != d:      # another length: cut or fill up, for the code alone
            x = np.pad(x[:, :d], ((0, 0), (0, max(0, d - x.shape[1]))))
        bits = (x - self.mean) @ self.projection >= 0
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def partners(x: np.ndarray, threshold: float, seed: int = 2) -> np.ndarray:
    """For each unit vector another one at exactly the threshold, in the direction of some other row
    (or any, if that is the row itself)."""
    rng = np.random.default_rng(seed)
    toward = x[rng.permutation(len(x))] - x + 1e-9 * rng.standard_normal(x.shape)
    toward -= (toward * x).sum(axis=1, keepdims=True) * x
    toward /= np.sqrt((toward * toward).sum(axis=1, keepdims=True))
    return threshold * x + np.sqrt(1 - threshold ** 2) * toward


def choose_tables(differ: np.ndarray) -> tuple[int, int, int]:
    """(chunk, radius, most bits apart) for rows of bits in which partners differ."""
    most = max(LEAST_BITS, int(np.quantile(differ.sum(axis=1), 0.995)))
    for chunk, radius in TABLES:
        found = (differ.reshape(len(differ), -1, chunk).sum(axis=2) <= radius).any(axis=1)
        if found.mean() >= RECALL:
            break
    return chunk, radius, most


def fit(df: DataFrame, id_col: str, vector_col: str, threshold: float = THRESHOLD) -> tuple[Quantiser, tuple] | None:
    """A quantiser for the most frequent vector length of the bounded sample, and its tables."""
    got = (df.select(id_col, vector_col).orderBy(F.xxhash64(F.col(id_col), F.col(vector_col))).limit(SAMPLE)
           .select(vector_col).toArrow())
    usable = [v for v in vectors(got.column(0)) if v is not None]
    if not usable:
        return None
    lengths = np.array([len(v) for v in usable])
    d = int(np.bincount(lengths).argmax())
    sample = np.stack([v for v in usable if len(v) == d])
    quantiser = Quantiser(sample)
    if d == 1:                                         # one component: unit vectors are equal or opposite
        return quantiser, (*TABLES[0], LEAST_BITS)
    bits = lambda x: np.unpackbits(quantiser.codes(x).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return quantiser, choose_tables(bits(sample) != bits(partners(sample, threshold)))


_ROW = "id long, label long, length int, name long, code long, vector binary"


def _encode(quantiser: Quantiser):
    def run(batches):
        import xxhash
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = vectors(part.column("vector"))
                labels = part.column("label").to_pylist()
                use = [v is not None and label is not None for v, label in zip(found, labels, strict=True)]
                n = len(found)
                length, name, code, body = [None] * n, [None] * n, [None] * n, [None] * n
                for d in {len(v) for v, u in zip(found, use, strict=True) if u}:
                    at = [i for i in range(n) if use[i] and len(found[i]) == d]
                    codes = quantiser.codes(np.stack([found[i] for i in at])).tolist()
                    for i, c in zip(at, codes, strict=True):
                        length[i], code[i], body[i] = d, c, (found[i] + 0.0).tobytes()
                        h = xxhash.xxh3_64_intdigest(body[i], seed=labels[i] & 0xFFFFFFFF)
                        name[i] = h - (1 << 64) if h >> 63 else h
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array(length, pa.int32()), pa.array(name, pa.int64()),
                     pa.array(code, pa.int64()), pa.array(body, pa.binary())],
                    [c.split()[0] for c in _ROW.split(", ")])

    return run


def cell_pairs(cells: DataFrame, chunk: int, radius: int, most: int) -> DataFrame:
    """(label, length, a, b): pairs of codes, a < b, that some table's probe brings
    together, each once, at most ``most`` bits apart."""
    chunks, top = BITS // chunk, (1 << chunk) - 1
    tables = F.explode(F.expr(f"transform(sequence(0, {chunks - 1}), c -> struct(c, shiftright(code, {chunk} * c) & {top} as key))"))
    index = cells.select("label", "length", F.col("code").alias("b"), tables.alias("t")).select(
        "label", "length", "b", "t.c", "t.key")
    flips = [sum(1 << i for i in at) for r in range(radius + 1) for at in itertools.combinations(range(chunk), r)]
    probes = (cells.select("label", "length", F.col("code").alias("a"), tables.alias("t"))
              .select("label", "length", "a", "t.c", F.explode(F.expr(
                  f"transform(array({', '.join(f'{m}L' for m in flips)}), m -> t.key ^ m)")).alias("key")))
    far = " AND ".join(f"(c <= {j} OR bit_count((a ^ b) & {_mask(chunk, j)}L) > {radius})" for j in range(chunks - 1))
    return (probes.join(index, ["label", "length", "c", "key"])
            .filter(f"a < b AND bit_count(a ^ b) <= {most} AND {far}").select("label", "length", "a", "b"))


def _mask(chunk: int, j: int) -> int:
    m = ((1 << chunk) - 1) << (chunk * j)
    return m - (1 << 64) if m >> 63 else m


def _rerank(threshold: float):
    """(name, links, via): for each node of two blocks with links between them, the vectors
    it links with and one node of its group."""
    def run(batches):
        for batch in batches:
            names, links, via = [], [], []
            for same, a, b in zip(batch.column("same").to_pylist(), batch.column("x").to_pylist(),
                                  batch.column("y").to_pylist(), strict=True):
                x = np.stack([np.frombuffer(m["vector"]) for m in a])
                y = x if same else np.stack([np.frombuffer(m["vector"]) for m in b])
                hit = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                nx, ny = (np.array([m["name"] for m in s]) for s in (a, b))
                cx, cy = (np.array([m["copies"] for m in s]) for s in (a, b))
                for side, own, other, weight in (((hit, nx, ny, cy),) if same else ((hit, nx, ny, cy), (hit.T, ny, nx, cx))):
                    for i in np.flatnonzero(side.any(axis=1)).tolist():
                        names.append(own[i])
                        links.append(int(weight[side[i]].sum()))
                        via.append(other[side[i].argmax()])
                for i, j in _join_up(hit):       # first partners alone may leave a group in parts
                    names.append(nx[i])
                    links.append(0)
                    via.append(ny[j])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(links, pa.int64()),
                                                  pa.array(via, pa.int64())], ["name", "links", "via"])

    return run


def _join_up(hit: np.ndarray) -> list[tuple[int, int]]:
    """Links that, with each row's and column's first one, connect what ``hit`` connects."""
    rows, columns = hit.shape
    parent = list(range(rows + columns))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        parent[root(i)] = root(rows + int(hit[i].argmax()))
    for j in np.flatnonzero(hit.any(axis=0)).tolist():
        parent[root(rows + j)] = root(int(hit[:, j].argmax()))
    out = []
    group = np.array([root(i) for i in range(rows + columns)])
    for i, j in zip(*np.nonzero(hit & (group[:rows, None] != group[None, rows:])), strict=True):
        a, b = root(int(i)), root(rows + int(j))
        if a != b:
            parent[a] = b
            out.append((int(i), int(j)))
    return out


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                     F.col(vector_col).alias("vector"))
    fitted = fit(rows, "id", "vector", threshold)
    if fitted is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    quantiser, tables = fitted
    coded = materialise(rows.mapInArrow(_encode(quantiser), _ROW))
    nodes = materialise(coded.filter("name IS NOT NULL").groupBy("name").agg(
        F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("length").alias("length"),
        F.first("code").alias("code"), F.first("vector").alias("vector")))
    cells = nodes.groupBy("label", "length", "code").agg(F.count(F.lit(1)).alias("n"))
    cell = ["label", "length", "code"]
    blocks = materialise(
        nodes.join(cells, cell)
        .withColumn("block", F.expr(f"pmod(xxhash64(name), (n + {BLOCK - 1}) div {BLOCK})"))
        .groupBy(*cell, "block").agg(F.collect_list(F.struct("name", "copies", "vector")).alias("members")))
    pairs = materialise(cell_pairs(cells.select(*cell), *tables))
    left = blocks.select("label", "length", F.col("code").alias("a"), F.col("block").alias("i"),
                         F.col("members").alias("x"))
    right = blocks.select("label", "length", F.col("code").alias("b"), F.col("block").alias("j"),
                          F.col("members").alias("y"))
    between = (pairs.join(left, ["label", "length", "a"]).join(right, ["label", "length", "b"])
               .select(F.lit(False).alias("same"), "x", "y"))
    within = blocks.filter(F.size("members") > 1).select(F.lit(True).alias("same"), F.col("members").alias("x"),
                                                         F.col("members").alias("y"))
    one = left.withColumnRenamed("a", "code")
    two = right.withColumnRenamed("b", "code")
    beside = one.join(two, cell).filter("i < j").select(F.lit(False).alias("same"), "x", "y")
    found = materialise(between.unionByName(within).unionByName(beside)
                        .mapInArrow(_rerank(threshold), "name long, links long, via long"))
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("name").alias("u"), F.col("via").alias("v")))
    linked = materialise(links.join(groups, links["name"] == groups["node"], "full").select(
        F.coalesce("name", "node").alias("name"), F.coalesce("links", F.lit(0)).alias("links"), "component"))
    known = (coded.select("id", "name")
             .join(nodes.filter("copies > 1").select("name", "copies"), "name", "left")
             .join(broadcast_if_small(linked), "name", "left"))
    known = materialise(known.withColumn("component", F.when(
        F.col("component").isNotNull() | (F.col("copies") > 1), F.coalesce("component", "name"))))
    smallest = materialise(known.filter("component IS NOT NULL").groupBy("component")
                           .agg(F.min("id").alias("smallest")))
    out = known.join(broadcast_if_small(smallest), "component", "left").select(
        F.col("id").alias("vec_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("smallest", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
