"""MinHash near-duplicates: a chosen-path similarity join, confirmed on full sets.

Documents with equal sets are one before the search. Each of several independent
trees places a document in the node of one minwise token; nodes that stay large
branch by more minwise tokens, until they are small or hardly shrink. In a small
node every pair is compared by sketches; nodes of thousands of alike documents
are compared block by block. What comes out is a spanning forest of candidate
links per node, never the pairs. Candidate groups are then compared on full
sets, again exhaustively and in blocks, and the confirmed links give components.

A pair at similarity 0.8 is missed by a tree with probability 0.2 at its root and
0.2^4 at each further level, so eight trees miss it with about 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import WORD_PATTERN, lower_ascii, mix64, slices, span_hashes, text_bytes, word_spans
from kindred.llm.components import connected_components, local_stars
from kindred.session import materialise, unbroadcast

HASHES = 64


@dataclass(frozen=True)
class Join:
    """``agree`` of the 64 sketch bytes must be equal for a candidate (51 are expected at 0.8).

    ``leaf`` and ``block_*`` bound the work of one comparison, not its result.
    """

    shingle: int = 5
    percent: int = 80
    trees: int = 8
    branches: int = 4
    depth: int = 6
    leaf: int = 256
    agree: int = 34
    block_docs: int = 1024
    block_shingles: int = 400_000


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (repeats included), and where each text's begin; short texts give one."""
    data, offsets = text_bytes(column)
    starts, ends, doc = word_spans(data := lower_ascii(data), offsets)
    words = span_hashes(data, starts, ends)
    n = len(column)
    count = np.bincount(doc, minlength=n)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x100000001B3) + words[i : i + len(rolled)]
    whole = doc[: len(rolled)] == doc[width - 1 :] if len(rolled) else np.zeros(0, bool)
    at, values = np.flatnonzero(whole), mix64(rolled[whole])
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < width))
    extra = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short):
        for h in words[first[d] : first[d] + count[d]]:
            extra[i] = extra[i] * np.uint64(0x100000001B3) + h
    extra = mix64(extra + count[short].astype(np.uint64))
    order = np.argsort(np.concatenate([at, first[short]]), kind="stable")
    sizes = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    return np.concatenate([values, extra])[order], np.concatenate([[0], np.cumsum(sizes)])


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    hashes, bounds = shingle_hashes(column, width)
    for i in range(len(column)):
        yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def signatures(docs: DataFrame, join: Join) -> DataFrame:
    """``doc_id, n_shingles, same, mins, sketch``: ``same`` is equal for equal sets; the last three are null without a set."""
    random = np.random.default_rng(1234)
    flips = random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    factors = random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, bounds = shingle_hashes(part.column("text"), join.shingle)
            full = np.flatnonzero(np.diff(bounds))
            mins = np.zeros((len(part), HASHES), np.uint32)
            if len(full):
                for k in range(HASHES):
                    seen = ((hashes ^ flips[k]) * factors[k] >> np.uint64(32)).astype(np.uint32)
                    mins[full, k] = np.minimum.reduceat(seen, bounds[full])
            sizes, same = [], []
            for i in range(len(part)):
                own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                sizes.append(len(own))
                same.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            sketch = mins.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()),
                    pa.array([m if s else None for m, s in zip(mins[:, : join.trees + 24].astype(np.int64), same)], pa.list_(pa.int64())),
                    pa.array([k.tobytes() if s else None for k, s in zip(sketch, same)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "same", "mins", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, same binary, mins array<long>, sketch binary"
    )


def by_key(df: DataFrame, key: str, work: Callable[[list[np.ndarray | pa.Array]], tuple], schema: str) -> DataFrame:
    """Bring the rows of a key together and hand them to ``work`` key by key, without a buffer per key in Spark.

    Keys must be of bounded size. ``work`` gets the columns of one key as Arrow
    arrays, and returns the output columns as arrays.
    """
    names = df.columns
    out = [c.split()[0] for c in schema.split(",")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            keys = batch.column(key)
            if len(batch) and (keys[0] != keys[len(batch) - 1] or held[0].column(key)[0] != keys[0]):
                ready = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = _last_start(ready, key)
                held = [ready.slice(cut)]
                yield from finish(ready.slice(0, cut))
        held = [b for b in held if len(b)]
        if held:
            yield from finish(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def finish(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = rows.column(key).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        results = [work([rows.column(c).slice(a, b - a) for c in names]) for a, b in zip(bounds[:-1], bounds[1:])]
        results = [r for r in results if r is not None and len(r[0])]
        if results:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*results)], out)

    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _last_start(rows: pa.RecordBatch, key: str) -> int:
    keys = rows.column(key).to_numpy(zero_copy_only=False)
    return int(np.flatnonzero(keys == keys[-1])[0])


def blocks(df: DataFrame, key: str, parts: str) -> DataFrame:
    """Deal the rows of each key to ``parts`` blocks and copy them to all pairs of blocks: column ``tile``.

    Every pair of rows is together in some tile of at most two blocks.
    """
    block = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(parts))
    low = F.least("block", "other")
    high = F.greatest("block", "other")
    return (
        df.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
        .withColumn("tile", F.xxhash64(key, low, high))
    )


def candidate_links(reps: DataFrame, join: Join) -> DataFrame:
    """Candidate links between representatives (``doc_id, mins, sketch``)."""
    roots = F.array(*[F.struct(F.xxhash64(F.lit(t), F.col("mins")[t]).alias("node")) for t in range(join.trees)])
    level = reps.select("doc_id", F.explode(roots).alias("n")).select("doc_id", "n.node", F.lit(None).cast("long").alias("above"))
    small, crowded = [], []
    for depth in range(join.depth):
        level = materialise(level, "nodes")
        sizes = level.groupBy("node").agg(F.count("*").alias("size"), F.max("above").alias("above")).where("size > 1")
        sizes = materialise(sizes, "sizes")
        full = level.select("doc_id", "node").join(sizes, "node")
        small.append(full.where(F.col("size") <= join.leaf).select("doc_id", "node"))
        stuck = (F.col("size") > join.leaf) & ((F.lit(depth + 1 == join.depth)) | (F.coalesce(F.col("above"), F.lit(1 << 60)) < F.col("size") * 2))
        crowded.append(full.where(stuck).select("doc_id", "node", "size"))
        open_ = (F.col("size") > join.leaf) & ~stuck
        if sizes.where(open_).isEmpty():
            break
        # a node draws the tokens to branch by from the positions that no root uses
        drawn = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(24 // join.branches)) * join.branches + join.trees + i for i in range(join.branches)]
        children = F.array(*[F.xxhash64("node", F.lit(i), F.element_at("mins", (p + 1).cast("int"))) for i, p in enumerate(drawn)])
        level = (
            full.where(open_).join(reps.select("doc_id", "mins"), "doc_id")
            .select("doc_id", F.explode(children).alias("node"), F.col("size").alias("above"))
        )
    sketches = reps.select("doc_id", "sketch")
    rows = _union(small).join(sketches, "doc_id").select("node", "doc_id", "sketch")
    links = by_key(rows, "node", lambda c: _alike(c[1], c[2], join.agree), "a long, b long")
    tiles = blocks(_union(crowded).withColumn("parts", F.ceil(F.col("size") / join.block_docs)), "node", "parts")
    tiles = tiles.join(sketches, "doc_id").select("tile", "doc_id", "sketch")
    return links.union(by_key(tiles, "tile", lambda c: _alike(c[1], c[2], join.agree), "a long, b long"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _forest(ids: np.ndarray, adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = local_stars(adjacent)
    at = np.flatnonzero(label != np.arange(len(ids)))
    return ids[at], ids[label[at]]


def _alike(ids: pa.Array, sketch: pa.Array, agree: int):
    ids = ids.to_numpy()
    order = np.argsort(ids, kind="stable")
    m = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, HASHES)[order]
    ids = ids[order]
    if len(ids) == 2:
        return (ids[1:], ids[:1]) if (m[0] == m[1]).sum() >= agree else None
    near = np.empty((len(ids), len(ids)), bool)
    step = max(1, (1 << 22) // (len(ids) * HASHES))
    for i in range(0, len(ids), step):
        near[i : i + step] = (m[i : i + step, None] == m[None]).sum(2, dtype=np.uint8) >= agree
    return _forest(ids, near)


def confirmed_links(docs: DataFrame, groups: DataFrame, join: Join) -> DataFrame:
    """Links (``a, b``) that hold on full sets, a spanning forest per tile of each group.

    ``groups`` has ``doc_id, group, n_shingles``; ``docs`` supplies the texts.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / join.block_docs), F.ceil(F.col("total") / join.block_shingles)).cast("long")
    placed = blocks(groups.join(sizes.select("group", parts.alias("parts")), "group"), "group", "parts")
    tiles = placed.groupBy("doc_id").agg(F.collect_list("tile").alias("tiles"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [s.tobytes() for s in _sets(part.column("text"), join.shingle)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tiles"), pa.array(sets, pa.binary())], ["doc_id", "tiles", "set"])

    schema = "doc_id long, tiles array<long>, set binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(tiles.hint("shuffle_hash"), "doc_id")
    rows = texts.select("doc_id", "tiles", "text").mapInArrow(build, schema).select("doc_id", "set", F.explode("tiles").alias("tile"))
    return by_key(rows.select("tile", "doc_id", "set"), "tile", lambda c: _equal_enough(c[1], c[2], join.percent), "a long, b long")


def _equal_enough(ids: pa.Array, sets: pa.Array, percent: int):
    ids = ids.to_numpy()
    order = np.argsort(ids, kind="stable")
    raw = sets.to_pylist()
    own = [np.frombuffer(raw[i], np.uint64) for i in order]
    ids, n = ids[order], len(ids)
    sizes = np.array([len(s) for s in own])
    if n == 2:
        both = len(np.intersect1d(own[0], own[1], assume_unique=True))
        return (ids[1:], ids[:1]) if 100 * both >= percent * (sizes.sum() - both) or ids[0] == ids[1] else None
    _, column, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float64)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((n, width), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        both += x @ x.T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return _forest(ids, linked)


def dedup(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Words are split at ASCII white space and lower-cased in A-Z; a text with
    fewer words than a shingle is one shingle. Null, empty and blank texts have
    no set, link with nothing and are kept. Equal sets link whatever their
    number; repeated rows with one ``doc_id`` are each returned and stay in one
    component. Null ids are returned with a null component. Long texts are used
    whole; an empty table gives an empty result; other columns are ignored.
    """
    signed = materialise(signatures(docs, join), "signatures")
    some = signed.where("same is not null and doc_id is not null")
    reps = materialise(
        some.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")),
        "representatives",
    )
    groups = connected_components(candidate_links(reps, join))
    groups = groups.union(groups.select("component", "component").distinct()).toDF("doc_id", "group")
    groups = materialise(groups.join(reps.select("doc_id", "n_shingles"), "doc_id"), "groups")
    found = connected_components(confirmed_links(docs, groups, join))
    roots = reps.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "same", F.coalesce("component", "doc_id").alias("component_id")
    )
    linked = some.select("doc_id", "n_shingles", "same").join(roots, "same").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("same is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents with one row of each group of near-duplicates, the smallest id; all columns stay.

    Of rows that repeat the smallest id and have a set, the one first by text and then
    by a hash of all columns stays. Rows without a set or an id are in no group: all stay.
    """
    found = materialise(dedup(docs, join), "verdicts")
    some = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    # one plan at any size: the ids that go grow with the input
    left = docs.join(unbroadcast(gone), some & (F.col("doc_id").cast("long") == F.col("_gone")), "left_anti")
    # only ids with several rows that have a set are ranked
    often = found.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    often = materialise(often.select(F.col("doc_id").alias("_often")), "repeated-ids")
    if often.isEmpty():
        return left
    own = some & (F.col("doc_id").cast("long") == F.col("_often"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = left.join(often, own, "left_semi").groupBy(F.col("doc_id").cast("long")).agg(F.min_by(row, F.struct("text", F.xxhash64(row))).alias("_first"))
    return left.join(often, own, "left_anti").union(first.select("_first.*"))
