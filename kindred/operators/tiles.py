"""Comparing every product of a category with every other one, in bounded tiles.

A category is cut into query parts and candidate parts of at most ``tile_rows``
rows. Parts are compared by matrix products. For the best ``k``, a task has one
query part at a time and lets the candidates pass by, keeping ``k`` rows per query:
no shortlists of parts are written or merged. For asked ranks, a task compares one
query part with one candidate part and returns a count per rank. Pairs are never
emitted, and a category that holds a third of all rows is spread over as many tasks
as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.distance import Weights
from kindred.session import materialise, materialise_waves

TILE_BYTES = 64 << 20
MAX_TILE_ROWS = 16_384
MIN_QUERY_ROWS = 256
CHUNK_CELLS = 500_000
CLOSE_SHARE = 0.25
#: Bytes of candidates copied to query parts at a time, and of a row without its vectors.
WAVE_BYTES, ROW_BYTES = 4 << 30, 100
#: Below every score.
NEVER = -(1 << 62)
QUERY_PART = ("category_id", "query_part")


@dataclass
class Grid:
    """Both sides copied to the tiles they belong to."""

    queries: DataFrame
    candidates: DataFrame
    large: DataFrame
    candidate_rows: int
    tasks: int
    single_pass: bool

    KEYS = ("category_id", "query_part", "candidate_part")

    def without(self, categories: DataFrame) -> "Grid":
        """The grid of the other categories."""
        queries, candidates = (
            side.join(categories.select("category_id"), "category_id", "left_anti")
            for side in (self.queries, self.candidates)
        )
        return replace(self, queries=queries, candidates=candidates)

    def apply(self, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
        left, right = (
            side.repartition(self.tasks, *self.KEYS).groupBy(*self.KEYS)
            for side in (self.queries, self.candidates)
        )
        return left.cogroup(right).applyInArrow(kernel, schema)


def tile_shape(row_bytes: int, pairs: int, largest: int, parallelism: int) -> tuple[int, int]:
    """(query rows, candidate rows) of a tile.

    Candidates are cut only when they exceed the memory budget of a task, since
    every further candidate part adds a shortlist per query. The query side is
    cut finer when the job would otherwise not keep all cores busy.
    """
    fitting = max(1, min(MAX_TILE_ROWS, TILE_BYTES // max(1, row_bytes)))
    share = pairs // (4 * parallelism * max(1, min(largest, fitting))) + 1
    return min(fitting, max(MIN_QUERY_ROWS, share)), fitting


def task_count(spark: SparkSession, tiles: int) -> int:
    """Tasks for a number of tiles: a few tiles each once all cores have work."""
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, min(tiles, max(4 * cores, tiles // 8)))


def build_grid(
    queries: DataFrame, candidates: DataFrame, row_bytes: int, tile_rows: int | None = None
) -> Grid:
    """Assign rows of the same ``category_id`` to tiles. ``tile_rows`` overrides
    the size of both sides.

    Both inputs should be materialised tables, as each is read twice.
    """
    spark = queries.sparkSession
    count = F.count(F.lit(1))
    sizes = materialise(
        queries.groupBy("category_id")
        .agg(count.alias("n_queries"))
        .join(candidates.groupBy("category_id").agg(count.alias("n_candidates")), "category_id"),
        "sizes",
    )
    parallelism = spark.sparkContext.defaultParallelism
    query_rows = candidate_rows = tile_rows
    if tile_rows is None:
        pairs, largest = sizes.agg(
            F.sum(F.col("n_queries") * F.col("n_candidates")), F.max("n_candidates")
        ).first()
        query_rows, candidate_rows = tile_shape(row_bytes, int(pairs or 0), largest or 0, parallelism)
    parts = lambda n, rows: F.ceil(F.col(n) / rows).cast("int")
    sizes = sizes.select(
        "category_id",
        parts("n_queries", query_rows).alias("query_parts"),
        parts("n_candidates", candidate_rows).alias("candidate_parts"),
    )
    tiles, widest = sizes.agg(
        F.sum(F.col("query_parts").cast("long") * F.col("candidate_parts")), F.max("candidate_parts")
    ).first()
    if (widest or 1) > 1 and "group_id" in candidates.columns:
        candidates = with_units(candidates, candidate_rows)
    # Few categories are larger than a tile. Being a file, this table is
    # broadcast by Spark if and only if its size is below the configured bound.
    large = materialise(sizes.where("query_parts > 1 OR candidate_parts > 1"), "large-categories")

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        counted = side.join(large, "category_id", "left")
        n_own, n_other = (F.coalesce(f"{name}_parts", F.lit(1)) for name in (own, other))
        return counted.select(
            *(F.col(c).alias(c) for c in side.columns),
            F.pmod("unit" if "unit" in side.columns else F.xxhash64("id"), n_own).cast("int").alias(f"{own}_part"),
            F.explode(F.sequence(F.lit(0), n_other - 1)).alias(f"{other}_part"),
        )

    return Grid(
        placed(queries, "query", "candidate"),
        placed(candidates, "candidate", "query"),
        large=large,
        candidate_rows=candidate_rows,
        tasks=task_count(spark, int(tiles or 0)),
        single_pass=(widest or 1) <= 1,
    )


def column_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix. Missing or shorter vectors are an
    error, as they would shift all rows after them."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths()
    if lists.null_count or (len(lists) and len(lengths.unique()) > 1):
        raise ValueError("vectors to compare must be there and of one length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_pandas().to_numpy()


class TileDistances:
    """Blended distances between the rows of two Arrow tables, in row chunks."""

    def __init__(self, queries: pa.Table, candidates: pa.Table, weights: Weights, null_safe_brand: bool):
        self.weights = weights
        self.vectors = [
            (factor, column_matrix(queries.column(name)), column_matrix(candidates.column(name)))
            for name, factor in weights.vectors().items()
        ]
        if weights.brand:
            names = pd.concat([queries.column("brand").to_pandas(), candidates.column("brand").to_pandas()])
            codes = pd.factorize(names)[0]
            self.query_brand, self.candidate_brand = np.split(codes, [queries.num_rows])
            if not null_safe_brand:
                self.candidate_brand = np.where(self.candidate_brand < 0, -2, self.candidate_brand)
        if weights.price:
            self.query_price, self.candidate_price = (
                t.column("price_hint").to_numpy().astype(float) for t in (queries, candidates)
            )

    def without_price(self, start: int, stop: int) -> np.ndarray:
        total = 0.0
        for factor, q, c in self.vectors:
            part = q[start:stop] @ c.T  # then in place, as new arrays of this size take longer than the sums
            total += np.multiply(np.subtract(1, part, out=part), factor, out=part)
        if self.weights.brand:
            differs = self.query_brand[start:stop, None] != self.candidate_brand[None, :]
            total += self.weights.brand * differs
        return total

    def rows(self, start: int, stop: int) -> np.ndarray:
        total = self.without_price(start, stop)
        if self.weights.price:
            total = total + self.price_share(self.query_price[start:stop, None], self.candidate_price[None, :])
        return total

    def price_share(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            gap = np.where(j < i, i - j, np.where(j > 1.1 * i, j - 1.1 * i, 0.0)) / (i + j)
        return self.weights.price * np.where(np.isfinite(gap), gap, 0.0)

    def most_by_price(self) -> np.ndarray | None:
        """For each query, what prices add to a distance at most; None if not known. The share
        grows to both sides of a query's price, so the cheapest and the dearest candidate tell."""
        if not self.weights.price:
            return np.zeros(len(self.vectors[0][1]) if self.vectors else 0)
        known = self.candidate_price[np.isfinite(self.candidate_price)]
        if self.weights.price < 0 or (known < 0).any() or (self.query_price < 0).any():
            return None
        ends = known.min(initial=np.inf), known.max(initial=-np.inf)
        return np.maximum(*(self.price_share(self.query_price, np.float64(end)) for end in ends))


def _chunks(n_rows: int, n_columns: int):
    step = max(1, CHUNK_CELLS // max(1, n_columns))
    for start in range(0, n_rows, step):
        yield start, min(n_rows, start + step)


def _same_id(query_ids: np.ndarray, candidate_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of cells that compare a product with itself."""
    q = pd.DataFrame({"id": query_ids, "row": np.arange(len(query_ids))})
    c = pd.DataFrame({"id": candidate_ids, "column": np.arange(len(candidate_ids))})
    both = q.merge(c, on="id").sort_values("row")
    return both["row"].to_numpy(), both["column"].to_numpy()


def with_units(candidates: DataFrame, rows: int) -> DataFrame:
    """Add ``unit``, by which a row is dealt to parts, and ``whole``: whether all rows of its unit go
    together. Groups do if they are small against parts of ``rows``; other rows are dealt by id."""
    names = ["category_id", "group_id"]
    sizes = candidates.where("group_id IS NOT NULL").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    large = materialise(sizes.where(F.col("n") > max(1, rows // 8)).select(*names, F.lit(True).alias("large")), "large-groups")
    counted = candidates if large.isEmpty() else candidates.join(large, names, "left")
    is_large = F.lit(False) if large.isEmpty() else F.coalesce("large", F.lit(False))
    alone = F.col("group_id").isNull()
    return counted.select(
        *(F.col(c).alias(c) for c in candidates.columns),
        F.when(alone | is_large, F.xxhash64("id")).otherwise(F.xxhash64("group_id", F.lit(3))).alias("unit"),
        (alone | ~is_large).alias("whole"),
    )


def _close_cells(base, own, starts, k, most, unit, limit, floor=None) -> tuple[np.ndarray, np.ndarray] | None:
    """Row and column numbers of the cells that can be among the best ``k`` units of their row, or
    None where that is not known or spares too little.

    ``base`` are distances without prices, which add between nothing and ``most``; units begin at
    the columns ``starts``. ``k`` units are no farther than the k-th smallest base and ``most``, so
    cells whose base is farther cannot count, nor cells that cannot reach the score ``floor``, where
    it is given. Cells of a product with itself (``own``) are left out.
    """
    if not (np.abs([base.min(), base.max()]).max() + 2 + most.max()) * unit < limit:
        return None
    base[own] = np.inf
    if floor is not None:
        reach = 1 - floor / unit + 2 / unit
    else:
        nearest = base if len(starts) == base.shape[1] else np.minimum.reduceat(base, starts, axis=1)
        reach = np.partition(nearest, k - 1, axis=1)[:, k - 1] + most + 2 / unit
    if not np.isfinite(reach).all():
        return None
    close = base <= reach[:, None]
    if np.count_nonzero(close) > close.size * CLOSE_SHARE:
        return None
    return np.divmod(np.flatnonzero(close), close.shape[1])


def _best_of_tile(left, right, k, weights, digits, null_safe_brand, final, floor=None):
    """Rows of ``left`` and of ``right`` and scores, in whole units of ``digits``, of the best ``k`` units
    per query; more in :func:`shortlist_kernel`. With ``floor``, a score per query that ``k`` units are
    known to reach elsewhere, only what reaches it as well."""
    unit, n = 10**digits, right.num_rows
    if not left.num_rows or not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    # below every score; times the number of rows it still fits 64 bits
    never = -((1 << 62) // max(1, n))
    out = {"row": [], "column": [], "score": []}
    groups = pd.factorize(right.column("group_id").to_pandas())[0]
    alone = groups < 0
    groups[alone] = groups.max(initial=-1) + 1 + np.arange(alone.sum())
    order = np.argsort(groups, kind="stable")
    right = right.take(pa.array(order))
    starts = np.flatnonzero(np.r_[True, np.diff(groups[order]) > 0])
    # where all of a group is in this tile, its representative is known, and it is cut like a product
    apart = ~alone[order]
    if "whole" in right.column_names:
        apart &= ~_values(right.column("whole")).astype(bool)
    ids, places = _values(right.column("id")), _values(right.column("pos"))
    by_id = np.argsort(ids, kind="stable")
    id_rank = np.empty(n, np.int64)
    id_rank[by_id] = np.arange(n)
    by_place = pd.DataFrame({"p": places, "i": ids}).sort_values(["p", "i"]).index.to_numpy()
    place_rank = np.empty(n, np.int64)
    place_rank[by_place] = np.arange(n)
    query_ids = _values(left.column("id"))
    self_rows, self_columns = _same_id(query_ids, ids)
    distances = TileDistances(left, right, weights, null_safe_brand)
    # the representative of a group in parts may be in another tile and have any id: at
    # equal similarity it comes before nothing for certain, and is never cut for its id
    open_ = apart[starts] & (not final)
    most = distances.most_by_price() if distances.vectors and (floor is not None or len(starts) > k) else None
    for start, stop in _chunks(left.num_rows, n):
        low, high = np.searchsorted(self_rows, (start, stop))
        own = self_rows[low:high] - start, self_columns[low:high]
        least_score = None if floor is None else floor[start:stop]
        base = None if most is None else distances.without_price(start, stop)
        cells = None if base is None else _close_cells(base, own, starts, k, most[start:stop], unit, -never, least_score)
        if cells is not None:
            row, at = cells
            if not len(row):
                continue
            exact = base[row, at]
            if weights.price:
                exact = exact + distances.price_share(distances.query_price[start:stop][row], distances.candidate_price[at])
            score = np.rint((1 - exact) * unit).astype(np.int64)
            owner = np.searchsorted(starts, at, side="right") - 1
            first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(owner) != 0)])
            best = np.maximum.reduceat(score * n + (n - 1 - place_rank[at]), first)
            row, owner, score = row[first], owner[first], best // n
            ranked = score * n + id_rank[by_place[n - 1 - best % n]]
            if floor is not None:
                picked = np.flatnonzero(score >= least_score[row])
                picked = picked[np.lexsort((-ranked[picked], row[picked]))]
                picked = picked[np.arange(len(picked)) - np.searchsorted(row[picked], row[picked]) < k]
            else:
                sure = np.where(open_[owner], score * n, ranked)
                # every query has k units here, so each has a k-th one
                kth = np.searchsorted(row, np.arange(stop - start)) + k - 1
                least = sure[np.lexsort((-sure, row))][kth]
                picked = np.where(open_[owner], score * n + n - 1, ranked) >= least[row]
            out["row"].append(row[picked] + start)
            out["column"].append(by_id[ranked[picked] % n])
            out["score"].append(score[picked])
            continue
        score = np.rint((1 - distances.rows(start, stop)) * unit)
        if not np.abs(score).max() < -never:  # also where a score is not a number
            raise ValueError(f"{digits} digits are too many for these scores, or a vector holds NaN")
        score = score.astype(np.int64)
        score[own] = never
        if len(starts) < n:
            best = np.maximum.reduceat(score * n + (n - 1 - place_rank), starts, axis=1)
            score = best // n
            ranked = score * n + id_rank[by_place[n - 1 - best % n]]
        else:
            ranked = score * n + id_rank
        valid = score > never
        if floor is not None:
            valid &= score >= least_score[:, None]
        if ranked.shape[1] > k:
            sure = np.where(open_, score * n, ranked)
            least = -np.partition(-sure, k - 1, axis=1)[:, k - 1 : k]
            valid &= np.where(open_, score * n + n - 1, ranked) >= least
        row, at = np.nonzero(valid)
        picked = ranked[row, at]
        out["row"].append(row + start)
        out["column"].append(by_id[picked % n])
        out["score"].append(picked // n)
    rows, columns, scores = (np.concatenate(v) if v else np.empty(0, np.int64) for v in out.values())
    return rows, order[columns], scores


def shortlist_kernel(k: int, weights: Weights, digits: int, null_safe_brand: bool, final: bool = False):
    """Best ``k`` units per query of a tile. A unit is a group (its best member
    by similarity, then position) or an ungrouped product; units are ordered by
    similarity, then id, both descending. The cut is exact: whatever is dropped
    has ``k`` units of this tile before it. A column ``whole`` of the candidates tells
    which have all rows of their unit in this tile."""
    unit = 10**digits

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, columns, scores = _best_of_tile(left, right, k, weights, digits, null_safe_brand, final)
        y = right.select(["id", "group_id", "pos"]).take(pa.array(columns, pa.int64()))
        return pa.table(
            {
                "idX": left.column("id").take(pa.array(rows, pa.int64())),
                "idY": y.column("id"),
                "group_id": y.column("group_id"),
                "pos": y.column("pos"),
                "score": pa.array(scores / unit, pa.float64()),
            }
        )

    return kernel


@dataclass(frozen=True)
class Search:
    """How the best ``k`` units of a query are found; ``rows`` candidates are compared at a time."""

    weights: Weights
    k: int
    digits: int
    null_safe_brand: bool
    rows: int


class Nearest:
    """The best ``k`` units of the queries of one part, while candidates come by in the order of
    (group, position, id). A group goes into one comparison as a whole; of one that has too many
    rows for that, the best member so far is kept until the group is over."""

    def __init__(self, queries: pa.Table, search: Search):
        n, self.queries, self.search = queries.num_rows, queries, search
        self.scores, self.codes = np.full((n, search.k), NEVER), np.full((n, search.k), -1)
        self.names = np.empty(0, object)
        self.held, self.size, self.going = [], 0, None
        self.best, self.best_name = np.full(n, NEVER), np.empty(n, object)

    def add(self, candidates: pa.Table) -> None:
        self.held.append(candidates)
        self.size += candidates.num_rows
        if self.size >= self.search.rows:
            self.compare()

    def compare(self, last: bool = False) -> None:
        """Compare what is held but for the last group, of which more may come."""
        table = pa.concat_tables(self.held).combine_chunks() if self.held else None
        self.held, self.size = [], 0
        groups = table.column("group_id").to_pandas().to_numpy(object) if table is not None else np.empty(0, object)
        if self.going is not None:
            others = np.flatnonzero(groups != self.going)
            more = others[0] if len(others) else len(groups)
            if more:
                self._part_of_group(table.slice(0, more))
                table, groups = table.slice(more), groups[more:]
            if last or len(groups):
                self._end_group()
        if not len(groups):
            return
        n = cut = len(groups)
        if not last and not pd.isna(groups[-1]):
            others = np.flatnonzero(groups != groups[-1])
            cut = others[-1] + 1 if len(others) else 0
        if cut == 0 and n >= self.search.rows:
            self.going = groups[-1]
            self._part_of_group(table)
            return
        if cut:
            self._keep(table.slice(0, cut), *self._best(table.slice(0, cut), self.search.k, self.scores[:, -1]))
        if cut < n:
            self.held, self.size = [table.slice(cut)], n - cut

    def _best(self, table: pa.Table, k: int, floor: np.ndarray | None):
        s = self.search
        floor = floor if floor is not None and (floor > NEVER).all() else None
        return _best_of_tile(self.queries, table, k, s.weights, s.digits, s.null_safe_brand, True, floor)

    def _part_of_group(self, table: pa.Table) -> None:
        rows, columns, scores = self._best(table, 1, None)
        better = scores > self.best[rows]  # rows come by position, so at equal scores the earlier one stays
        rows, ids = rows[better], _values(table.column("id"))
        self.best[rows], self.best_name[rows] = scores[better], ids[columns[better]]

    def _end_group(self) -> None:
        rows = np.flatnonzero(self.best > NEVER)
        names, codes = np.unique(self.best_name[rows], return_inverse=True)
        self._merge(rows, names, codes, self.best[rows])
        self.best[:], self.going = NEVER, None

    def _keep(self, table: pa.Table, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray) -> None:
        used, codes = np.unique(columns, return_inverse=True)
        self._merge(rows, _values(table.column("id"))[used].astype(object), codes, scores)

    def _merge(self, rows: np.ndarray, names: np.ndarray, codes: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        k, every = self.search.k, np.concatenate([self.names, names])
        rank = np.empty(len(every), np.int64)
        rank[np.argsort(every, kind="stable")] = np.arange(len(every))
        hit = np.unique(rows)
        row = np.r_[np.repeat(hit, k), rows]
        score, code = np.r_[self.scores[hit].ravel(), scores], np.r_[self.codes[hit].ravel(), codes + len(self.names)]
        there = np.flatnonzero(score > NEVER)
        order = there[np.lexsort((-rank[code[there]], -score[there], row[there]))]
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, place = order[place < k], place[place < k]
        self.scores[row[order], place], self.codes[row[order], place] = score[order], code[order]
        known = self.codes >= 0
        used, self.codes[known] = np.unique(self.codes[known], return_inverse=True)
        self.names = every[used]

    def sure(self) -> pa.Array:
        """Per query, the score that ``k`` units reach; null where there are fewer."""
        least = self.scores[:, -1]
        return pa.array(least / 10**self.search.digits, pa.float64(), mask=least <= NEVER)

    def found(self) -> pa.Table:
        rows, places = np.nonzero(self.codes >= 0)
        id_ = self.queries.column("id")
        names = pa.array(self.names, id_.type)
        return pa.table({
            "idX": id_.take(pa.array(rows)),
            "idY": names.take(pa.array(self.codes[rows, places])),
            "score": self.scores[rows, places] / 10**self.search.digits,
        })


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.Table]]:
    """(query part, side, rows) of batches that are sorted by them, piece by piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("category_id").to_pandas().to_numpy()
        parts, sides = batch.column("query_part").to_numpy(), batch.column("side").to_numpy()
        changes = (names[1:] != names[:-1]) | (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1])
        bounds = np.r_[0, np.flatnonzero(changes) + 1, batch.num_rows]
        table = pa.Table.from_batches([batch])
        for a, b in zip(bounds, bounds[1:]):
            yield (names[a], parts[a]), int(sides[a]), table.slice(a, b - a)


def nearest_batches(search: Search, result: Callable[[tuple, Nearest], Iterator[pa.RecordBatch]]):
    """Batches sorted by query part, side (queries first), group, position and id; gives ``result`` of every query part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, nearest = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            if not queries:  # candidates without a query
                return
            part = nearest or Nearest(pa.concat_tables(queries).combine_chunks(), search)
            part.compare(last=True)
            yield from result(key, part)

        for at, side, rows in _runs(batches):
            if at != key:
                yield from ended()
                key, queries, nearest = at, [], None
            if side == 0:
                queries.append(rows)
            elif queries:
                nearest = nearest or Nearest(pa.concat_tables(queries).combine_chunks(), search)
                nearest.add(rows)
        yield from ended()

    return run


def found_batches(_: tuple, part: Nearest) -> Iterator[pa.RecordBatch]:
    yield from part.found().to_batches(max_chunksize=1 << 16)


def search_parts(queries: DataFrame, candidates: DataFrame, tasks: int, kernel, schema: T.StructType) -> DataFrame:
    """Run a kernel of :func:`nearest_batches` over query parts. Both sides have the columns of a comparison,
    ``category_id`` and ``query_part``; candidates come once for every query part they are compared with."""
    names = [c for c in queries.columns if c not in QUERY_PART]
    sides = (side.select(*QUERY_PART, F.lit(i).alias("side"), *names) for i, side in enumerate((queries, candidates)))
    rows = reduce(DataFrame.unionByName, sides).repartition(tasks, *QUERY_PART)
    return rows.sortWithinPartitions(*QUERY_PART, "side", "group_id", F.asc_nulls_last("pos"), "id").mapInArrow(kernel, schema)


def in_waves(copies: int, row_bytes: int, run: Callable[[Callable[[DataFrame], DataFrame], int], DataFrame]) -> DataFrame:
    """Candidates that are copied to query parts take at most about ``WAVE_BYTES`` of disk at a time: more are
    handled in waves of query parts, each written before the next begins. ``run`` gets what keeps the
    query parts of a wave, and the number of waves."""
    waves = max(1, -(-copies * (row_bytes + ROW_BYTES) // WAVE_BYTES))
    if waves == 1:
        return run(lambda rows: rows, 1)
    wave = F.pmod(F.xxhash64(*QUERY_PART, F.lit(5)), F.lit(waves))
    return materialise_waves((run(lambda rows: rows.where(wave == i), waves) for i in range(waves)), "neighbours")  # noqa: B023


def search_all(features: DataFrame, candidates: DataFrame, large: DataFrame, search: Search, row_bytes: int, schema: T.StructType) -> DataFrame:
    """The best units of every query in the ``large`` categories (``category_id, query_parts``), by comparing all."""
    names = [c for c in features.columns if c != "category_id"]
    large = large.select("category_id", F.col("query_parts").cast("long").alias("query_parts"))
    counted = [side.select("category_id", *names).join(large, "category_id") for side in (features, candidates)]
    copies = counted[1].agg(F.sum("query_parts")).first()[0] or 0
    parts = large.agg(F.sum("query_parts")).first()[0] or 0
    queries = counted[0].select("category_id", F.pmod(F.xxhash64("id"), "query_parts").alias("query_part"), *names)
    others = counted[1].select("category_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1)).alias("query_part"), *names)
    kernel = nearest_batches(search, found_batches)

    def run(kept: Callable[[DataFrame], DataFrame], waves: int) -> DataFrame:
        tasks = task_count(features.sparkSession, -(-parts // waves))
        return search_parts(kept(queries), kept(others), tasks, kernel, schema)

    return in_waves(copies, row_bytes, run)


def rank_kernel(weights: Weights, digits: int, null_safe_brand: bool, exclude_self: bool):
    """For every asked (query, target, target distance): how many candidates of
    the tile come before the target by (distance, id). Target distances come in
    whole units of ``digits``, rounded half to even like those of candidates."""
    unit = 10**digits

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        if left.num_rows and n:
            right = right.take(pa.array(np.argsort(_values(right.column("id")), kind="stable")))
            ids = _values(right.column("id"))
            query_ids = _values(left.column("id"))
            self_rows, self_columns = _same_id(query_ids, ids)
            targets = left.column("targets").combine_chunks()
            owner = np.repeat(np.arange(left.num_rows), np.asarray(targets.value_lengths()))
            asked = targets.flatten()
            ask_id = asked.field("id").to_pandas().to_numpy()
            ask_distance = asked.field("distance").to_numpy().astype(np.int64)
            before_id = np.searchsorted(ids, ask_id)
            distances = TileDistances(left, right, weights, null_safe_brand)
            counts = np.empty(len(owner), np.int64)
            for start, stop in _chunks(left.num_rows, n):
                keys = np.rint(distances.rows(start, stop) * unit).astype(np.int64) * (n + 1) + np.arange(n)
                if exclude_self:
                    low, high = np.searchsorted(self_rows, (start, stop))
                    keys[self_rows[low:high] - start, self_columns[low:high]] = np.iinfo(np.int64).max
                keys.sort(axis=1)
                first, last = np.searchsorted(owner, (start, stop))
                wanted = ask_distance[first:last] * (n + 1) + before_id[first:last]
                bounds = np.searchsorted(owner[first:last], np.arange(start, stop + 1))
                for row in range(stop - start):
                    a, b = bounds[row], bounds[row + 1]
                    counts[first + a : first + b] = np.searchsorted(keys[row], wanted[a:b])
            return pa.table(
                {
                    "x": left.column("id").take(pa.array(owner, pa.int64())),
                    "y": asked.field("id"),
                    "w_y": asked.field("weight"),
                    "ahead": pa.array(counts),
                }
            )
        empty = pa.array([], left.schema.field("id").type)
        return pa.table(
            {"x": empty, "y": empty, "w_y": pa.array([], pa.float64()), "ahead": pa.array([], pa.int64())}
        )

    return kernel
