"""Embedding near-duplicates by range search on robust-pruned flat graphs.

Vectors are dealt to the cells of their nearest centroids, several each, so that
cells overlap; a cell too large for one task is cut into blocks, and pairs of
blocks meet in tiles. In a tile, small overlapping clusters each get a graph by
robust pruning, and their adjacency lists are united. Clumps of alike vectors are
collapsed to leaders at ever wider scales, and the leaders get graphs as well, so
that clumps of any size have edges to each other. A search goes greedily from the
medoids of the clusters (and from the query's own node), then expands over
everything it can reach inside the range from any node it has seen there. Links
are verified in double precision.

A bounded sample of vectors, some with links found and some without, is compared
with all others to audit the recall; if it falls short the search is done again
with more overlap. If it still does, or the sample has no link to measure it by,
the links are found exactly: a cell then meets every vector that can be in range
of one of its own, and tiles are compared in full. Tiles return sums and spanning
forests, never the pairs; a pair that meets in several tiles counts in one of them.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from kindred.llm.components import connected_components, local_stars
from kindred.llm.minhash_dedup import by_key
from kindred.session import materialise

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Range:
    """``overlaps`` are tried in turn until the audited recall reaches ``recall``; after the last the comparison is exact.

    ``audited`` vectors with links found and as many without are compared with all others.
    """

    cosine: float = 0.95
    overlaps: tuple[int, ...] = (2, 4, 8)
    recall: float = 0.99
    audited: int = 256
    sample: int = 20_000
    cell: int = 1_000
    most_cells: int = 4_096
    block: int = 1_500
    cluster: int = 200
    degree: int = 16
    candidates: int = 48
    alpha: float = 1.2
    beam: int = 8
    hops: int = 12
    scales: int = 6


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, unit, dim``: unit vectors as bytes of doubles; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, dims = [], []
            for vector in batch.column("embedding"):
                x = None
                if vector.is_valid and len(vector) and not vector.values.null_count:
                    x = vector.values.to_numpy().astype(np.float64)
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(top) and top > 0 else None
                    x = None if x is None else x / np.sqrt((x * x).sum())
                units.append(None if x is None else x.tobytes())
                dims.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "unit", "dim"])

    cast = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cast.mapInArrow(run, "vec_id long, unit binary, dim int")


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors; an emptied one keeps its place."""
    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])].copy()
    for _ in range(rounds if k > 1 else 1):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], first, axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def robust_prune(x: np.ndarray, spec: Range) -> np.ndarray:
    """Out-neighbours of every row of ``x`` among the rows, at most ``degree``; -1 fills up.

    Of the nearest candidates the nearest is taken, and those that lie much closer
    to it than to the point are dropped, again and again.
    """
    n = len(x)
    far = 2 - 2 * (x @ x.T)
    np.fill_diagonal(far, np.inf)
    k = min(spec.candidates, n - 1)
    if k < 1:
        return np.full((n, spec.degree), -1)
    candidates = np.argpartition(far, k - 1, axis=1)[:, :k]
    d = np.take_along_axis(far, candidates, 1)
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    alive, rows = np.ones((n, k), bool), np.arange(n)
    out = np.full((n, spec.degree), -1)
    for r in range(spec.degree):
        some = alive.any(1)
        if not some.any():
            break
        place = alive.argmax(1)
        chosen = candidates[rows, place]
        out[some, r] = chosen[some]
        alive[rows, place] = False
        alive &= ~(spec.alpha**2 * far[chosen[:, None], candidates] <= d)
    return out


def clumps(x: np.ndarray, spec: Range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members, the leader of each, and all leaders, from the narrowest scale to a quarter of the range.

    Each scale collapses the leaders of the one before; one that collapses nothing is left out.
    """
    left = np.arange(len(x))
    for scale in range(spec.scales, 0, -1):
        close = 2 - 2 * (x[left] @ x[left].T) <= (2 - 2 * spec.cosine) / 4**scale
        np.fill_diagonal(close, True)
        lead, free = np.arange(len(left)), np.ones(len(left), bool)
        for i in np.flatnonzero(close.sum(1) > 1):
            if free[i]:
                own = close[i] & free
                lead[own], free[own] = i, False
        kept = lead == np.arange(len(left))
        if not kept.all():
            yield left[~kept], left[lead[~kept]], left[kept]
            left = left[kept]


def flat_graph(x: np.ndarray, spec: Range) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency matrix of the united graphs of overlapping clusters, and the clusters' medoids."""
    n = len(x)
    m = max(1, -(-n // spec.cluster))
    centres = kmeans(x, m)
    near = x @ centres.T
    homes = np.argsort(-near, axis=1, kind="stable")[:, : min(2, m)]
    adjacent, medoids = np.zeros((n, n), bool), []
    for c in range(m):
        # clusters of alike vectors can be large: their graphs are built in parts
        own = np.flatnonzero((homes == c).any(1))
        if not len(own):
            continue
        medoids.append(own[near[own, c].argmax()])
        for i in range(0, len(own), spec.block):
            part = np.unique(np.concatenate([own[i : i + spec.block], medoids[-1:]]))
            lists = robust_prune(x[part], spec)
            u, r = np.nonzero(lists >= 0)
            adjacent[part[u], part[lists[u, r]]] = True
    for members, leaders, own in clumps(x, spec):
        adjacent[members, leaders] = True
        lists = robust_prune(x[own], spec)
        u, r = np.nonzero(lists >= 0)
        adjacent[own[u], own[lists[u, r]]] = True
    np.fill_diagonal(adjacent, False)
    return adjacent | adjacent.T, np.array(medoids)


def search(x: np.ndarray, adjacent: np.ndarray, medoids: np.ndarray, queries: np.ndarray, spec: Range) -> np.ndarray:
    """Rows of ``x`` inside the range of each query row, as a boolean matrix."""
    n, q = len(x), len(queries)
    low = x.astype(np.float32)
    width = int(adjacent.sum(1).max(initial=1))
    lists = np.full((n, min(width, 4 * spec.degree)), -1)
    for v in range(n):
        own = np.flatnonzero(adjacent[v])[: lists.shape[1]]
        lists[v, : len(own)] = own
    target = low[queries]
    # greedy: a pool of the best nodes seen, of which the best one not yet expanded is expanded next
    near = target @ low[medoids].T
    take = np.argsort(-near, axis=1, kind="stable")[:, : spec.beam]
    pool, score = medoids[take], np.take_along_axis(near, take, 1)
    done = np.zeros(pool.shape, bool)
    rows = np.arange(q)
    # what is seen inside the range (with room for single precision) counts, in the pool or not
    fresh, least = np.zeros((q, n), bool), spec.cosine - 1e-4
    fresh[:, medoids] = near >= least
    for _ in range(spec.hops):
        open_ = np.where(done, -np.inf, score)
        place = open_.argmax(1)
        if not np.isfinite(open_[rows, place]).any():
            break
        done[rows, place] = True
        new = lists[pool[rows, place]]
        gained = np.where(new >= 0, np.einsum("qd,qkd->qk", target, low[new]), -np.inf)
        r, c = np.nonzero(gained >= least)
        fresh[r, new[r, c]] = True
        ids, values = np.concatenate([pool, new], 1), np.concatenate([score, gained], 1)
        seen = np.concatenate([done, np.zeros(new.shape, bool)], 1)
        order = np.lexsort((~seen, ids), axis=1)
        ids, values, seen = (np.take_along_axis(a, order, 1) for a in (ids, values, seen))
        values[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
        order = np.argsort(-values, axis=1, kind="stable")[:, : spec.beam]
        pool, score, done = (np.take_along_axis(a, order, 1) for a in (ids, values, seen))
        done |= ~np.isfinite(score)
    # range: what is reached from inside the range, until nothing new is inside
    visited, inside = np.zeros((q, n), bool), np.zeros((q, n), bool)
    fresh[rows[:, None], np.where(np.isfinite(score), pool, queries[:, None])] = True
    fresh[rows, queries] = True
    links = adjacent.astype(np.float32)
    while fresh.any():
        visited |= fresh
        r, c = np.nonzero(fresh)
        hit = np.zeros(len(r), bool)
        for i in range(0, len(r), 1 << 16):
            s = slice(i, i + (1 << 16))
            hit[s] = np.einsum("id,id->i", x[queries[r[s]]], x[c[s]]) >= spec.cosine
        front = np.zeros((q, n), bool)
        front[r[hit], c[hit]] = True
        inside |= front
        used = np.flatnonzero(front.any(0))
        fresh = (front[:, used].astype(np.float32) @ links[used] > 0) & ~visited
    inside[rows, queries] = False
    return inside


def _tile_links(columns: list[pa.Array], spec: Range, exact: bool = False):
    """``kind, a, b``: the links of each vector counted in this tile (kind 0), and a spanning forest (kind 1)."""
    _, ids, copies, unit, cells, cell, block, two = columns
    ids, copies, block = (c.to_numpy() for c in (ids, copies, block))
    order = np.argsort(ids, kind="stable")
    x = _matrix(unit)[order]
    ids, copies, block = ids[order], copies[order], block[order]
    mine = cell[0].as_py()
    homes = np.array(cells.to_pylist())[order]
    n = len(ids)
    if n < 2:
        return None
    adjacent, medoids = (None, None) if exact else flat_graph(x, spec)
    split = two[0].as_py()
    linked, total = np.zeros((n, n), bool), np.zeros(n, np.int64)
    for i in range(0, n, 256):
        queries = np.arange(i, min(n, i + 256))
        linked[queries] = x[queries] @ x.T >= spec.cosine if exact else search(x, adjacent, medoids, queries, spec)
    np.fill_diagonal(linked, False)
    # a link holds both ways, whichever search has found it
    linked |= linked.T
    for i in range(0, n, 256):
        a, b = np.nonzero(linked[i : i + 256])
        a += i
        both = homes[a][:, :, None] == homes[b][:, None, :]
        first = np.where(both, homes[a][:, :, None], np.iinfo(np.int64).max).min((1, 2))
        counted = (first == mine) & ((block[a] != block[b]) == split)
        total += np.bincount(a[counted], copies[b[counted]], n).astype(np.int64)
    label = local_stars(linked)
    hung = np.flatnonzero(label != np.arange(n))
    some = np.flatnonzero(total)
    return (
        np.concatenate([np.zeros(len(some), np.int64), np.ones(len(hung), np.int64)]),
        np.concatenate([ids[some], ids[hung]]), np.concatenate([total[some], ids[label[hung]]]),
    )


def _tiles(reps: DataFrame, centres: np.ndarray, overlap: int, spec: Range) -> DataFrame:
    """Rows of every tile: ``tile, vec_id, copies, unit, cells, cell, block, two``; ``two`` if it joins two blocks."""
    dim = centres.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.repeat(-dims[:, None].astype(np.int64), overlap, 1)
            fit = np.flatnonzero(dims == dim)
            if len(fit):
                near = _matrix(batch.column("unit").take(pa.array(fit))) @ centres.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                cells[fit] = np.pad(best, ((0, 0), (0, overlap - best.shape[1])), mode="edge")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    schema = StructType([*reps.schema.fields, StructField("cells", ArrayType(LongType()))])
    dealt = materialise(reps.mapInArrow(deal, schema).withColumn("cell", F.explode(F.array_distinct("cells"))), "cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / spec.block).alias("parts"))
    rows = dealt.join(F.broadcast(sizes), "cell") if len(centres) <= spec.most_cells else dealt.join(sizes, "cell")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tile = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(tile.alias("tile"), "vec_id", "copies", "unit", "cells", "cell", "block", (F.col("block") != F.col("other")).alias("two"))


def _exact_tiles(reps: DataFrame, centres: np.ndarray, spec: Range) -> DataFrame:
    """Tiles in which every pair in range meets once, with the columns of ``_tiles``.

    Each vector is at home in the cell of its nearest centroid ``h``. A vector at home
    with ``c`` lies on that centroid's side of the plane between ``c`` and ``h``, so a
    vector farther from the plane than the range has no partner there. The others
    visit ``c`` (from the later cells only, as pairs are symmetric), and the blocks
    of visitors, numbered below 0, meet those at home.
    """
    dim = centres.shape[1]
    reach = np.sqrt(1 - spec.cosine**2) if spec.cosine > 0 else 1.0
    between = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            home, visits = -dims.astype(np.int64), [[] for _ in dims]
            fit = np.flatnonzero(dims == dim)
            for i in range(0, len(fit), 1024):
                some = fit[i : i + 1024]
                near = _matrix(batch.column("unit").take(pa.array(some))) @ centres.T
                own = home[some] = near.argmax(1)
                can = near - near.max(1, keepdims=True) >= -reach * between[own] - 1e-6
                for j, row in enumerate(can):
                    visits[some[j]] = np.flatnonzero(row[: own[j]]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(visits, pa.list_(pa.int64()))], [*batch.schema.names, "home", "visits"])

    schema = StructType([*reps.schema.fields, StructField("home", LongType()), StructField("visits", ArrayType(LongType()))])
    dealt = reps.mapInArrow(deal, schema)
    at_home = F.struct(F.col("home").alias("cell"), F.lit(True).alias("own"))
    visiting = F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own")))
    dealt = materialise(dealt.withColumn("place", F.explode(F.concat(F.array(at_home), visiting))).select(*reps.columns, "place.*"), "exact-cells")
    count = lambda own: F.ceil(F.count(F.when(F.col("own") == own, 1)) / spec.block)
    sizes = dealt.groupBy("cell").agg(count(True).alias("homes"), count(False).alias("guests"))
    rows = dealt.join(F.broadcast(sizes), "cell") if len(centres) <= spec.most_cells else dealt.join(sizes, "cell")
    hashed = F.xxhash64("vec_id")
    rows = rows.withColumn("block", F.when(F.col("own"), F.pmod(hashed, F.col("homes"))).otherwise(-1 - F.pmod(hashed, F.greatest("guests", F.lit(1)))))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    homes = F.when(F.col("homes") > 0, F.sequence(zero, F.col("homes") - 1)).otherwise(F.array().cast("array<long>"))
    guests = F.when(F.col("guests") > 0, F.transform(F.sequence(one, F.col("guests")), lambda g: -g)).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("own"), F.concat(homes, guests)).otherwise(homes)))
    tile = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(
        tile.alias("tile"), "vec_id", "copies", "unit", F.array("cell").alias("cells"), "cell", "block", (F.col("block") != F.col("other")).alias("two")
    )


def audit(reps: DataFrame, counts: DataFrame, spec: Range) -> tuple[float, float]:
    """Links that the search has found, and that there are among all rows, estimated from bounded samples.

    Vectors with links found and vectors without are drawn apart, by a hash, and each
    sample stands for all of its kind.
    """
    marked = reps.join(counts.select("vec_id", F.lit(1).alias("linked")), "vec_id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    kinds = {r["linked"]: r["count"] for r in marked.groupBy("linked").count().collect()}
    drawn = [
        marked.where(F.col("linked") == kind).select("vec_id", "unit", "dim", "linked").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(spec.audited).toPandas()
        for kind in kinds
    ]
    chosen = pd.concat(drawn)
    weight = {k: kinds[k] / len(d) for k, d in zip(kinds, drawn)}
    queries = {d: (g["vec_id"].to_numpy(), np.stack([np.frombuffer(u) for u in g["unit"]])) for d, g in chosen.groupby("dim")}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d, (ids, x) in queries.items():
                own = np.flatnonzero(dims == d)
                if len(own):
                    rows = batch.take(pa.array(own))
                    near = _matrix(rows.column("unit")) @ x.T >= spec.cosine
                    near &= rows.column("vec_id").to_numpy()[:, None] != ids[None]
                    n = near.T.astype(np.int64) @ rows.column("copies").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["vec_id", "n"])

    true = reps.select("vec_id", "unit", "dim", "copies").mapInArrow(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    rows = true.join(counts, "vec_id", "left").select("n", F.coalesce("found", F.lit(0)).alias("found"), F.col("found").isNotNull().cast("int").alias("linked")).collect()
    return sum(weight[r["linked"]] * min(r["n"], r["found"]) for r in rows), sum(weight[r["linked"]] * r["n"] for r in rows)


def dedup(rows: DataFrame, spec: Range = Range()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``rows`` (``vec_id, embedding``).

    Vectors that are null, empty or zero, or hold a null or a non-finite component,
    link with nothing and are kept; vectors of different lengths do not link. Equal
    directions are one node with a count, so any number of copies is exact.
    Repeated rows of one id each count as a vector. A null id is returned with a
    null component and links with nothing. An empty table gives an empty result.
    """
    units = unit_vectors(rows).withColumn("same", F.xxhash64("unit", "dim")).withColumn("same2", F.crc32("unit"))
    units = materialise(units, "units")
    usable = units.where("unit is not null and vec_id is not null")
    key = ["same", "same2"]
    reps = materialise(
        usable.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("dim").alias("dim")),
        "representatives",
    )
    n = reps.count()
    dims = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    alone = units.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))
    sample = reps.where(F.col("dim") == dims["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(spec.sample).select("unit").toPandas()["unit"]
    x = np.stack([np.frombuffer(u) for u in sample])
    centres = kmeans(x, int(np.clip(-(-n // spec.cell), 1, min(spec.most_cells, len(x)))))
    own = reps.select("vec_id", "copies", "unit", "dim")
    for overlap in (*spec.overlaps, None):
        exact = overlap is None
        tiles = _exact_tiles(own, centres, spec) if exact else _tiles(own, centres, overlap, spec)
        found = materialise(by_key(tiles, "tile", lambda c: _tile_links(c, spec, exact), "kind long, a long, b long"), "found")
        counts = materialise(found.where("kind = 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("b").alias("found")), "counts")
        if exact:
            log.info("exact comparison")
            break
        right, all_ = audit(own, counts, spec)
        log.info("overlap %d: %.0f of %.0f audited links found", overlap, right, all_)
        # nothing to measure by: no overlap can be vouched for
        if not all_:
            continue
        if right >= spec.recall * all_:
            break
    components = connected_components(found.where("kind = 1").select("a", "b"))
    nodes = reps.join(counts, "vec_id", "left").join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        *key, (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    out = usable.join(nodes, key).select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
