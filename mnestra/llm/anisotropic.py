"""Problem 1: the most similar vectors for every vector.

Method: score-aware anisotropic quantisation.  Unit vectors are cut into
subspaces of four dimensions, each coded by one of 16 centres (four bits).  Codes
and centres are fitted to a loss that weighs the error along the vector more
than the error across it, because only the former moves the inner products of
close pairs.  A scan adds up table entries by code for every query and vector of
a block; whatever the scan puts above ``threshold - margin`` is ranked again with
the exact cosine similarity of the full vectors, so no cap is set on candidates.

Blocks: a group (bank) of at most ``large`` vectors is one block, where
``large`` is 4,096 or, beyond 4 * 10^8 vectors, a hundred-thousandth of all, so
that at most 100,000 groups are ever named to the tasks.  Larger groups are
parted by centroids into leaves of about ``leaf_rows``; every vector is stored in
its nearest leaf and looked up in its ``probes`` nearest ones.  A leaf with more
than ``large`` vectors is split further and its lookups go to every part.
Centroids and centres are fitted on at most ``sample_rows`` vectors; all vectors
are indexed.

Defined results: a vector counts only if it has ``dim`` finite elements that are
not all zero, and a group that is not null; repeated rows count once; copies of
one vector enter the index once, and among equally similar nodes the least ids
come first, so a node never gets more than ``k`` partners of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnestra.session import materialise, spread

SUB = 4
CENTRES = 16


def parallel_weight(dim: int, floor: float) -> float:
    """How much more the parallel error weighs, when scores above ``floor`` matter."""
    return max(1.0, (dim - 1) * floor**2 / (1 - floor**2))


def encode(x: np.ndarray, centres: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes that minimise |r|^2 + (eta - 1) (r . x)^2 of the residual r, by subspace in turn."""
    n, m = len(x), len(centres)
    parts = x.reshape(n, m, SUB)
    norms = (parts**2).sum(axis=2)
    dots = np.einsum("nms,mcs->nmc", parts, centres, optimize=True)
    across = norms[:, :, None] - 2 * dots + (centres**2).sum(axis=2)[None]
    along = norms[:, :, None] - dots
    codes = across.argmin(axis=2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (across[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
            total = rest + along[rows, j, codes[:, j]]
    return codes


def fit_centres(x: np.ndarray, eta: float, rounds: int = 6) -> np.ndarray:
    """Centres of all subspaces under the same loss, by alternating codes and least squares."""
    n, dim = x.shape
    m = dim // SUB
    parts = x.reshape(n, m, SUB)
    centres = np.stack([parts[np.arange(CENTRES) * n // CENTRES, j] for j in range(m)]).astype(np.float64)
    for _ in range(rounds):
        codes = encode(x, centres, eta)
        along = (parts * (parts - centres[np.arange(m), codes])).sum(axis=2)
        total = along.sum(axis=1)
        for j in range(m):
            rest = total - along[:, j] + (parts[:, j] ** 2).sum(axis=1)
            for c in np.unique(codes[:, j]):
                mine = codes[:, j] == c
                p = parts[mine, j]
                left = len(p) * np.eye(SUB) + (eta - 1) * p.T @ p
                centres[j, c] = np.linalg.solve(left, (p + (eta - 1) * rest[mine, None] * p).sum(axis=0))
    return centres.astype(np.float32)


def fit_leaves(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; empty leaves keep their centroid."""
    centroids = x[np.arange(k) * len(x) // k].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(nearest, kind="stable")
        leaves, begin = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(x[order], begin, axis=0)
        centroids[leaves] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
    return (codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)


def scan(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate inner products (vectors x queries) from table entries alone."""
    m = len(centres)
    tables = np.einsum("qms,mcs->mcq", queries.reshape(len(queries), m, SUB), centres, optimize=True).astype(np.float32)
    if m % 2:
        tables = np.concatenate([tables, np.zeros((1, CENTRES, len(queries)), np.float32)])
    scores = np.zeros((len(packed), len(queries)), np.float32)
    for j in range(packed.shape[1]):
        table = (tables[2 * j][:, None, :] + tables[2 * j + 1][None, :, :]).reshape(CENTRES * CENTRES, -1)
        scores += table[packed[:, j]]
    return scores


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(bank_id, node_id, kind, v): usable vectors as bytes; equal vectors of a bank are one kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            whole = lists.flatten()
            if whole.null_count:
                whole = whole.fill_null(float("nan"))
            raw = whole.to_numpy(zero_copy_only=False).reshape(-1, dim)
            fine = np.flatnonzero(np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1))
            kept = batch.take(pa.array(fine))
            raw = raw[fine] + np.float32(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], names=["bank_id", "node_id", "v"])

    sized = vectors.select(F.col("bank_id"), F.col("node_id").cast("long").alias("node_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(
        (F.size("embedding") == dim) & F.col("bank_id").isNotNull() & F.col("node_id").isNotNull()
    )
    return sized.mapInArrow(run, "bank_id string, node_id long, v binary").withColumn("kind", F.xxhash64("bank_id", "v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _of_banks(rows: DataFrame, banks: list[str]) -> DataFrame:
    """Rows of some banks, of which there are at most 100,000."""
    named = rows.sparkSession.createDataFrame([(b,) for b in banks], "bank_id string")
    return rows.join(F.broadcast(named), "bank_id", "left_semi")


def _sample(kinds: DataFrame, rows: int, n: int, dim: int, banks: list[str] | None) -> np.ndarray:
    some = kinds if banks is None else _of_banks(kinds, banks)
    picked = some.filter(F.pmod(F.col("kind"), F.lit(max(1, math.ceil(n / rows)))) == 0).select("v").limit(2 * rows).toArrow()
    return _matrix(picked.column(0).combine_chunks() if picked.num_rows else pa.array([], pa.binary()), dim)


class _Block:
    """The vectors of one block, then its lookups as they come."""

    def __init__(self, key: tuple) -> None:
        self.key, self.kinds, self.raw, self.codes = key, [], [], []
        self.ready: tuple | None = None

    def add(self, kinds: np.ndarray, raw: np.ndarray, codes: np.ndarray) -> None:
        self.kinds.append(kinds)
        self.raw.append(raw)
        self.codes.append(codes)

    def close(self) -> tuple:
        if self.ready is None:
            self.ready = (np.concatenate(self.kinds), unit(np.concatenate(self.raw)), np.concatenate(self.codes)) if self.kinds else ()
        return self.ready


def _search(block: _Block, kinds: np.ndarray, queries: np.ndarray, centres: np.ndarray, threshold: float, margin: float, k: int) -> Iterator[tuple]:
    stored = block.close()
    if not stored:
        return
    own, vectors, packed = stored
    for lo in range(0, len(queries), 1024):
        q = queries[lo : lo + 1024]
        at, by = np.nonzero(scan(q, packed, centres) >= threshold - margin)
        if not len(at):
            continue
        exact = np.concatenate([(vectors[at[i : i + 65536]] * q[by[i : i + 65536]]).sum(axis=1) for i in range(0, len(at), 65536)])
        good = (exact >= threshold - 1e-12) & (own[at] != kinds[lo:][by])
        at, by, exact = at[good], by[good], exact[good]
        order = np.lexsort((-exact, by))
        at, by, exact = at[order], by[order], exact[order]
        rank = np.arange(len(by)) - np.searchsorted(by, by)
        tenth = np.full(len(q), -1.0)
        tenth[by[rank == k - 1]] = exact[rank == k - 1]
        keep = (rank < k) | (exact >= tenth[by])
        yield kinds[lo:][by[keep]], own[at[keep]], exact[keep]


def similar_vectors(
    vectors: DataFrame, k: int = 10, threshold: float = 0.9, dim: int = 64, margin: float = 0.3, probes: int = 8, leaf_rows: int = 512, sample_rows: int = 32_768, score_floor: float = 0.2, large: int = 4096
) -> DataFrame:
    """Pairs of nodes of a bank, at least one being among the ``k`` most similar of the other.

    ``vectors(bank_id, node_id, embedding)`` -> ``(node_id_1, node_id_2)``,
    node_id_1 < node_id_2, with a cosine similarity of at least ``threshold``.
    """
    if dim % SUB:
        raise ValueError(f"dim must be a multiple of {SUB}")
    spark = vectors.sparkSession
    nodes = _usable(spread(vectors.select("bank_id", "node_id", "embedding")), dim)
    members = materialise(nodes.select("kind", "node_id").distinct(), "members")
    kinds = materialise(nodes.dropDuplicates(["kind"]).select("bank_id", "kind", "v"), "kinds")
    sizes = kinds.groupBy("bank_id").count()
    n, largest = kinds.count(), 0
    large = max(large, n // 100_000)
    counts = {r["bank_id"]: r["count"] for r in sizes.filter(F.col("count") > large).collect()}
    sample = unit(_sample(kinds, sample_rows, n, dim, None))
    eta = parallel_weight(dim, score_floor)
    centres = fit_centres(sample, eta) if len(sample) else np.zeros((dim // SUB, CENTRES, SUB), np.float32)
    leaves = np.zeros((1, dim), np.float32)
    if counts:
        largest = max(counts.values())
        of_large = unit(_sample(kinds, sample_rows, sum(counts.values()), dim, list(counts)))
        leaves = fit_leaves(of_large.astype(np.float32), int(min(max(1, largest // leaf_rows), max(1, len(of_large) // 8), 4096)))
    model = spark.sparkContext.broadcast((centres, leaves, frozenset(counts)))
    probes = min(probes, len(leaves))

    def leaf_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, leaves, _ = model.value
        for batch in batches:
            x = unit(_matrix(batch.column(1), dim)).astype(np.float32) if batch.num_rows else np.zeros((0, dim), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x @ leaves.T).argmax(axis=1).astype(np.int32))], names=["bank_id", "leaf"])

    splits: dict[tuple[str, int], int] = {}
    if counts:
        full = _of_banks(kinds, list(counts)).select("bank_id", "v").mapInArrow(leaf_sizes, "bank_id string, leaf int").groupBy("bank_id", "leaf").count().filter(F.col("count") > large)
        splits = {(r["bank_id"], r["leaf"]): math.ceil(r["count"] / large) for r in full.collect()}  # at most n / large, that is 100,000
    parts = spark.sparkContext.broadcast(splits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, leaves, wide = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(2), dim))
            codes = pack(encode(x, centres, eta))
            bank = batch.column(0).to_pylist()
            kind = batch.column(1).to_numpy()
            rows, leaf, part, side = [], [], [], []
            parted = np.array([b in wide for b in bank], bool)
            rows.append(np.flatnonzero(~parted))
            for a in (leaf, part, side):
                a.append(np.full(len(rows[0]), -1 if a is leaf else 0, np.int32))
            for lo in range(0, int(parted.sum()), 2048):
                some = np.flatnonzero(parted)[lo : lo + 2048]
                near = np.argsort(-(x[some].astype(np.float32) @ leaves.T), axis=1, kind="stable")[:, :probes]
                row, at = np.repeat(some, probes), near.ravel().astype(np.int32)
                nearest = np.tile(np.arange(probes) == 0, len(some))
                copies = np.array([parts.value.get((bank[r], t), 1) for r, t in zip(row.tolist(), at.tolist())] if parts.value else np.ones(len(row)), np.int64)
                nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, at, nearest, copies = (np.repeat(v, copies) for v in (row, at, nearest, copies))
                rows.append(row)
                leaf.append(at)
                part.append(nth.astype(np.int32))
                side.append(np.where(nearest & (kind[row] % copies == nth), 0, 1).astype(np.int32))
            taken = np.concatenate(rows)
            out = batch.take(pa.array(taken))
            yield pa.RecordBatch.from_arrays(
                [out.column(0), pa.array(np.concatenate(leaf)), pa.array(np.concatenate(part)), pa.array(np.concatenate(side)), out.column(1), out.column(2), pa.array([r.tobytes() for r in codes[taken]], pa.binary())],
                names=["bank_id", "leaf", "part", "side", "kind", "v", "code"],
            )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = model.value[0]
        width = (len(centres) + 1) // 2
        block: _Block | None = None
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            a, b, s = (np.concatenate(x) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "similarity"])

        def own_lookups(done: _Block | None) -> None:
            """The stored vectors of a block are its first lookups."""
            if done is not None and done.ready is None and done.close():
                out.extend(_search(done, done.ready[0], done.ready[1], centres, threshold, margin, k))

        for batch in batches:
            if not batch.num_rows:
                continue
            bank = batch.column(0).dictionary_encode()
            leaf, part, side = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            code = bank.indices.to_numpy()
            change = np.flatnonzero((code[1:] != code[:-1]) | (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            kind = batch.column(4).to_numpy()
            raw = _matrix(batch.column(5), dim)
            packed = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, width)
            for lo, hi in zip(bounds, bounds[1:]):
                key = (bank.dictionary[int(code[lo])].as_py(), int(leaf[lo]), int(part[lo]))
                if block is None or block.key != key:
                    own_lookups(block)
                    block = _Block(key)
                if side[lo] == 0:
                    block.add(kind[lo:hi], raw[lo:hi], packed[lo:hi])
                else:
                    own_lookups(block)
                    out.extend(_search(block, kind[lo:hi], unit(raw[lo:hi]), centres, threshold, margin, k))
            if out:
                yield rows()
        own_lookups(block)
        if out:
            yield rows()

    placed = kinds.select("bank_id", "kind", "v").mapInArrow(place, "bank_id string, leaf int, part int, side int, kind long, v binary, code binary")
    blocks = placed.repartition("bank_id", "leaf", "part").sortWithinPartitions("bank_id", "leaf", "part", "side")
    one_way = materialise(blocks.mapInArrow(find, "a long, b long, similarity double"), "found")
    found = one_way.union(one_way.select("b", "a", "similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    nearest = found.withColumn("rank", F.rank().over(Window.partitionBy("a").orderBy(F.desc("similarity")))).filter(F.col("rank") <= k)
    by_id = Window.partitionBy("kind").orderBy("node_id")
    first = members.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1).select(F.col("kind").alias("b"), F.col("node_id").alias("other"))
    several = members.groupBy("kind").count().filter("count > 1").select(F.col("kind").alias("a"), F.col("kind").alias("b"), F.lit(2.0).alias("similarity"))
    options = nearest.select("a", "b", "similarity").unionByName(several).join(first, "b").select(F.col("a").alias("kind"), "other", "similarity")
    listed = members.join(options, "kind").filter("node_id <> other")
    chosen = listed.withColumn("nth", F.row_number().over(Window.partitionBy("node_id", "kind").orderBy(F.desc("similarity"), "other"))).filter(F.col("nth") <= k)
    return chosen.select(F.least("node_id", "other").alias("node_id_1"), F.greatest("node_id", "other").alias("node_id_2")).distinct()
