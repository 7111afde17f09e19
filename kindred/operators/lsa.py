"""Latent semantic vectors by randomised subspace iteration.

Documents are the rows of a sparse tf-idf matrix ``A``. A block ``y`` of random
directions, one row per document, is multiplied by ``A A'`` again and again and
made orthonormal in between, until it spans the leading left singular vectors.
Documents live in shards. Terms that occur in one shard only are multiplied
there; of the others, the shards' sums are added up, and a shard asks for those of
its terms. One pass over the shards does both halves of a product. Shards take turns
in waves, so that disk holds the sums of one wave and one row per shared term, not
the sums of all shards.

What the driver sees are square matrices of the block's width: the triangular
factors of a tall-skinny QR, and a Gram matrix for the final rotation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.vectors import l2_normalize
from kindred.operators.terms import tfidf
from kindred.session import materialise, materialise_waves, scratch_path

#: Entries that are multiplied at once, bytes of a record (files are read some thousand records at a time), and triangular factors that are joined at once.
CHUNK, RECORD_BYTES, FAN = 1 << 9, 1 << 12, 16
#: Bytes of the sums of shared terms that one task adds up.
BLOCK_BYTES = 1 << 24
#: Bytes of the sums of shared terms that the shards of one wave take; a wave keeps all cores busy nevertheless.
WAVE_BYTES = 1 << 31
#: Directions weaker than this share of the strongest are noise of the arithmetic.
NOISE = 1e-11

#: Records of a pass, with matrices as bytes: of documents (``y`` and their product over the shard's own terms),
#: of shared terms (``p`` from a shard, ``a`` asked for, ``t`` summed, ``s`` sent back), and Gram matrices (``g``).
RECORDS = "shard int, kind string, block int, ids binary, matrix binary, local binary"
_KINDS = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("block", pa.int32()), *((n, pa.binary()) for n in ("ids", "matrix", "local"))])


def _record(shard: int, kind: str, matrix: np.ndarray, ids: np.ndarray | None = None, block: int = 0, local: np.ndarray | None = None) -> dict:
    pack = lambda x, t: None if x is None else np.ascontiguousarray(x, t).tobytes()
    return {"shard": shard, "kind": kind, "block": block, "ids": pack(ids, np.int64), "matrix": pack(matrix, float), "local": pack(local, float)}


def _unpacked(records: list[dict], column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of several records, in the order of the ids."""
    if not records:
        return np.zeros(0, np.int64), np.zeros((0, width))
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in records])
    rows = np.concatenate([np.frombuffer(r[column], float).reshape(-1, width) for r in records])
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order]


def spread(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, bits well mixed (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_rows(keys: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A row of uniform numbers in -1..1 per key, the same wherever the key is met."""
    steps = (np.arange(1, width + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    return spread(keys.view(np.uint64)[:, None] + steps).astype(np.float64) / 2.0**63 - 1


def summed(index: np.ndarray, weights: np.ndarray, rows: np.ndarray, matrix: np.ndarray, size: int) -> np.ndarray:
    """Row ``i`` of the result is the weighted sum of the matrix rows at the places where the (ascending) index is ``i``."""
    out = np.zeros((size, matrix.shape[1]))
    for a in range(0, len(index), CHUNK):
        part = index[a : a + CHUNK]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[starts]] += np.add.reduceat(weights[a : a + CHUNK, None] * matrix[rows[a : a + CHUNK]], starts, axis=0)
    return out


def _step(width: int, blocks: int, seed: int, turn: np.ndarray | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One pass over a shard: finish the last product, turn it, begin the next one.

    Without ``turn``, the random start instead. Gives ``y`` and the product over
    the shard's own terms per document, the shard's sums of shared terms in
    blocks, and the Gram matrix of its own terms.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("row")
        n, names = len(left), left.column("row").to_numpy()
        lists = {c: left.column(c).combine_chunks() for c in ("terms", "weights", "shared")}
        weights = lists["weights"].flatten().to_numpy()
        ids, at = np.unique(lists["terms"].flatten().to_numpy(), return_inverse=True)
        shared = np.zeros(len(ids), bool)
        shared[at] = lists["shared"].flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(n), np.asarray(lists["terms"].value_lengths()))
        if turn is None:
            y = summed(doc, weights, at, random_rows(ids, width, seed), n)
        else:
            records = right.to_pylist()
            _, y = _unpacked([r for r in records if r["kind"] == "y"], "local", len(turn))
            known, sums = _unpacked([r for r in records if r["kind"] == "s"], "matrix", len(turn))
            if len(known):
                use = shared[at]
                y = y + summed(doc[use], weights[use], np.searchsorted(known, ids)[at[use]], sums, n)
            y = y @ turn
        order = np.argsort(at, kind="stable")
        products = summed(at[order], weights[order], doc[order], y, len(ids))
        own, mine = products[~shared], ~shared[at]
        local = summed(doc[mine], weights[mine], (np.cumsum(~shared) - 1)[at[mine]], own, n)
        shard, size = left.column("shard")[0].as_py(), max(1, RECORD_BYTES // (8 * y.shape[1]))
        out = [_record(shard, "g", own.T @ own)]
        for i in range(0, n, size):
            out.append(_record(shard, "y", y[i : i + size], names[i : i + size], local=local[i : i + size]))
        block = ids.view(np.uint64) % np.uint64(blocks)
        for b in np.unique(block[shared]).tolist():
            here = np.flatnonzero(shared & (block == b))
            out += [_record(shard, "p", products[h], ids[h], b) for h in (here[i : i + size] for i in range(0, len(here), size))]
        return pa.Table.from_pylist(out, _KINDS)

    return run


def _asked(blocks: int) -> Callable[[pa.Table], pa.Table]:
    """The shared terms of a shard, by block."""

    def run(rows: pa.Table) -> pa.Table:
        terms, shared = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "shared"))
        ids, shard = np.unique(terms[shared.astype(bool)]), rows.column("shard")[0].as_py()
        block = ids.view(np.uint64) % np.uint64(blocks)
        out = [{"shard": shard, "kind": "a", "block": int(b), "ids": ids[block == b].tobytes()} for b in np.unique(block)]
        return pa.Table.from_pylist(out, _KINDS)

    return run


def _answered(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The sums of the shared terms of one block that shards have asked for."""

    def run(asked: pa.Table, sums: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _KINDS.empty_table()
        known, rows = _unpacked(sums.to_pylist(), "matrix", width)
        out, size = [], max(1, RECORD_BYTES // (8 * width))
        for r in asked.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            matrix = rows[np.searchsorted(known, ids)]
            out += [_record(r["shard"], "s", matrix[i : i + size], ids[i : i + size], r["block"]) for i in range(0, len(ids), size)]
        return pa.Table.from_pylist(out, _KINDS)

    return run


def _added(width: int) -> Callable[[pa.Table], pa.Table]:
    """The sums of the shared terms of one block: of the shards of a wave, after those of the waves before,
    which come as shard -1. So they are added in the order of the shards, whatever the waves."""

    def run(parts: pa.Table) -> pa.Table:
        records = sorted(parts.to_pylist(), key=lambda r: r["shard"])
        known = [np.frombuffer(r["ids"], np.int64) for r in records]
        ids = np.unique(np.concatenate(known))
        total, size = np.zeros((len(ids), width)), max(1, RECORD_BYTES // (8 * width))
        for r, k in zip(records, known):
            total[np.searchsorted(ids, k)] += np.frombuffer(r["matrix"], float).reshape(-1, width)
        out = [_record(-1, "t", total[i : i + size], ids[i : i + size], records[0]["block"]) for i in range(0, len(ids), size)]
        return pa.Table.from_pylist(out, _KINDS)

    return run


def _reduced(records: DataFrame, width: int, start: Callable, join: Callable) -> np.ndarray | None:
    """Matrices of ``width`` columns joined to one, a few at a time: in each task first, then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for matrix in batch.column(0):
                matrix = np.frombuffer(matrix.as_buffer(), float).reshape(-1, width)
                found = start(matrix) if found is None else join(found, matrix)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found).tobytes()], pa.binary())], ["matrix"])

    parts = records.select("matrix").mapInArrow(run, "matrix binary")
    left = parts.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(run, "matrix binary")
    found = None
    for row in parts.collect():
        matrix = np.frombuffer(row.matrix, float).reshape(-1, width)
        found = start(matrix) if found is None else join(found, matrix)
    return found


def _squared(sums: DataFrame, width: int) -> DataFrame:
    """Gram matrices of the sums of shared terms, one per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = np.concatenate([np.frombuffer(m.as_buffer(), float).reshape(-1, width) for m in batch.column(0)])
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["matrix"])

    return sums.select("matrix").mapInArrow(run, "matrix binary")


def triangular_factor(records: DataFrame, width: int) -> np.ndarray:
    """R of a tall-skinny QR of all rows ``y``."""
    factor = lambda x: np.linalg.qr(x, mode="r")
    found = _reduced(records.where("kind = 'y'"), width, factor, lambda r, x: factor(np.vstack([r, x])))
    return np.zeros((1, width)) if found is None else found


def orthonormal(factor: np.ndarray) -> np.ndarray:
    """What makes the columns of a matrix with this triangular factor orthonormal; dependent ones go."""
    _, values, vectors = np.linalg.svd(factor)
    keep = values > NOISE * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    return vectors[keep].T / values[keep]


def _sharded(weights: DataFrame, key: str, shard_entries: int) -> tuple[DataFrame, int, int, int, int]:
    """Documents with their terms in shards, and the numbers of shards, of terms, of shared terms in shards, and of shared terms.

    Terms are known by a hash of the word; a seed is taken with which no two are equal.
    """
    seed = 0
    while True:
        hashed = weights.withColumn("term", F.xxhash64(F.lit(seed), "word"))
        words = hashed.select("word", "term").distinct()
        n_terms, n_hashes = words.agg(F.count("*"), F.count_distinct("term")).first()
        if n_terms == n_hashes:
            break
        seed += 1
    shards = max(1, -(-weights.count() // shard_entries))
    entries = hashed.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    where = materialise(entries.select("shard", "term").distinct(), "shard-terms")
    several = where.groupBy("term").agg(F.count("*").alias("n")).where("n > 1").select("term", F.lit(True).alias("shared"))
    entries = entries.join(several, "term", "left") if shards > 1 else entries.withColumn("shared", F.lit(None).cast("boolean"))
    docs = entries.groupBy("shard", key).agg(
        F.array_sort(F.collect_list(F.struct("term", "weight", F.coalesce("shared", F.lit(False)).alias("shared")))).alias("e")
    )
    docs = docs.select(
        "shard", F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"),
        F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"), F.col("e.shared").alias("shared"),
    )
    pairs, n_shared = (where.join(several, "term", "left_semi").count(), several.count()) if shards > 1 else (0, 0)
    return materialise(docs, "lsa-documents"), shards, n_terms, pairs, n_shared


def lsa_projection(
    docs: DataFrame, rank: int, key: str = "id", max_df: float = 0.9,
    iterations: int = 5, oversample: int = 10, seed: int = 7, shard_bytes: int = 1 << 26,
) -> tuple[DataFrame, list[float]]:
    """Documents on the leading ``rank`` singular directions of their smoothed
    tf-idf matrix: (``key, projected``), and the singular values.

    ``oversample`` directions more than asked for are carried along, and the block is
    multiplied ``iterations`` times. Where the matrix has fewer directions than
    that, one pass is exact. The block's rows for one shard take at most
    ``shard_bytes`` (but a document is never parted). Shards depend on the data
    only, so the result does not depend on the cluster but for rounding. Each
    direction points to where its sum over documents is positive. Documents
    without terms are left out; directions the matrix does not have are zero.
    """
    weights = materialise(tfidf(docs, key, smooth=True, max_df=max_df).select(key, "word", "weight"), "tfidf")
    width = rank + oversample
    rows, shards, n_terms, pairs, n_shared = _sharded(weights, key, max(1, shard_bytes // (8 * width)))
    if rank > n_terms:
        raise ValueError(f"rank {rank} is larger than the vocabulary of {n_terms} terms")
    static = rows.select("shard", "row", "terms", "weights", "shared")
    spark = rows.sparkSession
    n_waves = max(1, -(-pairs * 8 * width // WAVE_BYTES))
    per_wave = min(shards, max(2 * spark.sparkContext.defaultParallelism, -(-shards // n_waves)))
    keeping = lambda first: lambda side: side.where(F.col("shard").between(first, first + per_wave - 1))
    waves = [keeping(first) for first in range(0, shards, per_wave)]
    # rows of a wave, and of all shared terms
    blocks = max(1, -(-(-(-pairs // len(waves)) + n_shared) * 8 * width // min(BLOCK_BYTES, shard_bytes)))
    by_shard = lambda side: side.repartition(4 * per_wave, "shard").groupBy("shard")
    by_block = lambda side: side.repartition(blocks, "block").groupBy("block")
    state, turn, shared = spark.createDataFrame([], RECORDS), None, None
    # a pass reads the one before and its sums, and the sums of the waves before, and nothing older
    paths = [scratch_path(spark, "lsa-pass") for _ in range(2)]
    wave_path, *sum_paths = [scratch_path(spark, name) for name in ("lsa-wave", "lsa-sums", "lsa-sums", "lsa-sums")]
    shared_path = None

    def passed_waves(turn: np.ndarray | None, size: int) -> Iterator[DataFrame]:
        """Records of documents and Gram matrices, wave by wave; the sums of shared terms go into ``sums``."""
        nonlocal sums, sums_path
        for kept in waves:
            side = kept(state)
            if shared is not None:
                asked = by_shard(kept(static)).applyInArrow(_asked(blocks), RECORDS)
                side = side.unionByName(by_block(asked).cogroup(by_block(shared)).applyInArrow(_answered(len(turn)), RECORDS))
            step = by_shard(kept(static)).cogroup(by_shard(side)).applyInArrow(_step(width, blocks, seed, turn), RECORDS)
            if not pairs:
                yield step
                continue
            step = materialise(step, path=wave_path)
            parts = step.where("kind = 'p'")
            sums_path = next(p for p in sum_paths if p not in (shared_path, sums_path))
            sums = materialise(by_block(parts if sums is None else parts.unionByName(sums)).applyInArrow(_added(size), RECORDS), path=sums_path)
            yield step.where("kind <> 'p'")

    for i in range(iterations + 1):
        size = width if turn is None else turn.shape[1]
        sums = sums_path = None
        passed = materialise_waves(passed_waves(turn, size), path=paths[i % 2])
        state = passed.where("kind = 'y'").select(*_KINDS.names[:4], F.lit(None).cast("binary").alias("matrix"), "local")
        shared, shared_path = sums, sums_path
        turn = orthonormal(triangular_factor(passed, size))
        if turn.shape[1] < size:
            # the matrix has fewer directions than the block, which so spans them all
            break
    grams = [_reduced(passed.where("kind = 'g'"), size, lambda x: x.copy(), lambda total, x: total + x)]
    if shared is not None:
        squared = _squared(shared, size)
        grams.append(_reduced(squared, size, lambda x: x.copy(), lambda total, x: total + x))
    gram = sum((g for g in grams if g is not None), np.zeros((size, size)))
    squares, directions = np.linalg.eigh(turn.T @ gram @ turn)
    order = np.argsort(-squares)[:rank]
    values = np.sqrt(np.maximum(squares[order], 0))
    onto = np.zeros((size, rank))
    onto[:, : len(order)] = turn @ directions[:, order] * values
    return _projected(rows, passed.where("kind = 'y'"), onto), [*values.tolist(), *[0.0] * (rank - len(order))]


def _projected(rows: DataFrame, found: DataFrame, onto: np.ndarray) -> DataFrame:
    """Rows ``y`` turned onto the singular directions."""
    total = _reduced(found, len(onto), lambda x: x.sum(axis=0, keepdims=True), lambda a, x: a + x.sum(axis=0, keepdims=True))
    if total is not None:
        onto = onto * np.where(total[0] @ onto < 0, -1.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in zip(batch.column(0), batch.column(1)):
                out = np.frombuffer(matrix.as_buffer(), float).reshape(-1, len(onto)) @ onto
                vectors = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_buffer(), np.int64)), vectors], ["row", "projected"])

    vectors = found.select("ids", "matrix").mapInArrow(run, "row long, projected array<double>")
    return rows.select("row", "key").join(vectors, "row").select("key", "projected")


def lsa_title_vectors(docs: DataFrame, rank: int = 300, key: str = "id", max_df: float = 0.9, **options) -> DataFrame:
    """``key, title_vec``: unit LSA vectors of ``tokens`` (stems); a document without terms gets zeros."""
    projected, _ = lsa_projection(docs, rank, key, max_df, **options)
    known = projected.select(F.col("key").alias(key), l2_normalize("projected").alias("title_vec"))
    zero = F.array_repeat(F.lit(0.0), rank)
    return docs.select(key).join(known, key, "left").select(key, F.coalesce("title_vec", zero).alias("title_vec"))


def explained_variance(docs: DataFrame, ranks: list[int], key: str = "id", max_df: float = 0.9, **options) -> DataFrame:
    """``rank, explained``: share of the tf-idf variance kept by each rank.

    One decomposition at the largest rank serves every smaller one.
    """
    projected, _ = lsa_projection(docs, max(ranks), key, max_df, **options)
    weights = tfidf(docs, key, smooth=True, max_df=max_df)
    n = docs.select(F.count(F.lit(1)).alias("n")).scalar()
    total = weights.groupBy("word").agg(_variance("weight", n).alias("v")).agg(F.sum("v").alias("v"))
    kept = projected.select(F.posexplode("projected").alias("pos", "x")).groupBy("pos").agg(_variance("x", n).alias("v"))
    sizes = docs.sparkSession.createDataFrame([(r,) for r in ranks], "rank int")
    return (
        sizes.join(kept, F.col("pos") < F.col("rank"))
        .groupBy("rank")
        .agg((F.sum("v") / total.scalar()).alias("explained"))
    )


def _variance(column: str, n) -> Column:
    """Population variance over ``n`` rows of which the missing ones are zero."""
    mean = F.sum(column) / n
    return F.sum(F.col(column) * F.col(column)) / n - mean * mean
