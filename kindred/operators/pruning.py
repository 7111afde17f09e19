"""Exact neighbour search in large categories without comparing everything.

Products of a category that exceeds one tile are put into cells around pivot
products. Each product is first compared with a part of its own cell, which
gives a score that ``k`` neighbours reach for certain. A part of another cell is
then compared only if the triangle inequality, its brands and its price range
leave room for that score. The result is the same as that of all comparisons;
how much is saved depends on how clustered the products are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.distance import Weights
from kindred.operators.tiles import (
    QUERY_PART,
    Nearest,
    Search,
    column_matrix,
    found_batches,
    in_waves,
    nearest_batches,
    search_parts,
    task_count,
)
from kindred.session import materialise

MAX_PIVOTS = 512
SAMPLE_PER_PIVOT = 16
SHELLS = 12
SLACK = 1e-7
WORTHWHILE = 0.5
PART = ("category_id", "cell", "shell")
SURE_ROWS = 1024


def can_prune(weights: Weights) -> bool:
    """The bounds need distances that only grow with their parts."""
    return min(weights.title, weights.image, weights.product, weights.brand, weights.price) >= 0


def _blended_matrix(table: pa.Table | pa.RecordBatch, weights: Weights) -> np.ndarray:
    """One vector per product whose inner products are the blended ones."""
    parts = [np.sqrt(f) * column_matrix(table.column(name)) for name, f in weights.vectors().items()]
    return np.hstack(parts)


def _choose_pivots(features: DataFrame, weights: Weights, count: int) -> np.ndarray:
    """At most ``count`` products that cover a repeatable sample, farthest first.

    The sample is bounded by ``count``. Pivots that attract almost nothing are
    dropped, because a nearly empty cell gives its members no sure score.
    """
    names = list(weights.vectors())
    seen = features.select("id", *names).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE_PER_PIVOT * count)
    rows = _blended_matrix(seen.select(*names).toArrow(), weights)
    chosen, nearest = [0], np.linalg.norm(rows - rows[0], axis=1)
    owner = np.zeros(len(rows), int)
    while len(chosen) < count and nearest.max() > 1e-6:
        chosen.append(int(nearest.argmax()))
        distance = np.linalg.norm(rows - rows[chosen[-1]], axis=1)
        owner[distance < nearest] = len(chosen) - 1
        nearest = np.minimum(nearest, distance)
    kept = np.bincount(owner, minlength=len(chosen)) >= min(SAMPLE_PER_PIVOT // 4, len(rows) // len(chosen))
    return rows[np.array(chosen)[kept]]


def _reaches(table: pa.Table | pa.RecordBatch, weights: Weights, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths of the products' blended vectors, and their distances to all pivots."""
    rows = _blended_matrix(table, weights)
    norms = np.einsum("nd,nd->n", rows, rows)
    return norms, np.sqrt(np.maximum(norms[:, None] + np.einsum("pd,pd->p", pivots, pivots) - 2 * rows @ pivots.T, 0))


def _cell_assigner(shared, weights: Weights):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            norms, reaches = _reaches(batch, weights, pivots)
            usable = np.arange(len(pivots)) < batch.column("pivots").to_numpy()[:, None]
            cell = np.where(usable, reaches, np.inf).argmin(axis=1)
            added = {
                "cell": pa.array(cell.astype(np.int32)),
                "reach": pa.array(reaches[np.arange(len(cell)), cell]),
                "norm": pa.array(norms),
            }
            kept = [c for c in batch.schema.names if c != "pivots"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + list(added.values()), names=kept + list(added)
            )

    return assign


def _assign_cells(side: DataFrame, large: DataFrame, shared, weights: Weights) -> DataFrame:
    """Rows of the large categories with their cell, the distance to its pivot, and the square of their length."""
    schema = T.StructType(
        side.schema.fields
        + [
            T.StructField("cell", T.IntegerType()),
            T.StructField("reach", T.DoubleType()),
            T.StructField("norm", T.DoubleType()),
        ]
    )
    return side.join(large.select("category_id", "pivots"), "category_id").select(
        *side.columns, "pivots"
    ).mapInArrow(_cell_assigner(shared, weights), schema)


def _cut_cells(assigned: DataFrame, weights: Weights, rows: int, name: str, shells: int = 1) -> DataFrame:
    """Add ``shell`` and the part number ``name``. A cell is cut into shells of
    similar distance to its pivot, and a shell of more than ``rows`` products by
    hash, so even near copies of one product stay spread out."""
    widest = 2 * np.sqrt(sum(weights.vectors().values()))
    shell = F.floor(F.col("reach") * shells / float(widest) / (1 + SLACK)).cast("int")
    shelled = assigned.withColumn("shell", shell)
    slices = materialise(
        shelled.groupBy(*PART).agg(F.ceil(F.count(F.lit(1)) / rows).alias("slices")), "slices"
    )
    slice_ = F.pmod(F.xxhash64("id"), F.col("slices"))
    part = (F.col("cell").cast("long") * (shells + 1) + F.col("shell")) * F.lit(1 << 32) + slice_
    return shelled.join(slices, list(PART)).withColumn(name, part).drop("slices")


def _part_facts(candidates: DataFrame, weights: Weights) -> DataFrame:
    """What is known about all candidates of a part, one row per part."""
    facts = [F.count(F.lit(1)).alias("n_candidates"), F.first("shell").alias("candidate_shell"), F.min("reach").alias("near"), F.max("reach").alias("far"), F.max("norm").alias("norm_max")]
    if weights.brand:
        whole = (F.count("brand") == F.count(F.lit(1))) & (F.min("brand") == F.max("brand"))
        facts.append(F.when(whole, F.min("brand")).alias("only_brand"))
    if weights.price:
        price = F.when(~F.isnan("price_hint") & (F.col("price_hint") > 0), F.col("price_hint"))
        whole = F.count(price) == F.count(F.lit(1))
        facts += [F.when(whole, F.min(price)).alias("cheapest"), F.when(whole, F.max(price)).alias("dearest")]
    return candidates.groupBy("category_id", "candidate_part", F.col("cell").alias("candidate_cell")).agg(*facts)


def least_distance(weights: Weights) -> Column:
    """Lower bound of the distance of a query to every candidate of a part."""
    there = F.element_at("reaches", F.col("candidate_cell") + 1)
    gap = F.greatest(F.lit(0.0), there - F.col("far"), F.col("near") - there)
    inner = F.least(
        (F.col("norm") + F.col("norm_max") - gap * gap) / 2, F.sqrt(F.col("norm") * F.col("norm_max"))
    )
    bound = sum(weights.vectors().values()) - inner
    if weights.brand:
        differs = F.coalesce(F.col("brand") != F.col("only_brand"), F.lit(False))
        bound = bound + F.when(differs, weights.brand).otherwise(0.0)
    if weights.price:
        j, low, high = F.col("price_hint"), F.col("cheapest"), F.col("dearest")
        usable = j.isNotNull() & ~F.isnan(j) & (j > 0) & low.isNotNull()
        share = (
            F.when(usable & (j < low), (low - j) / (low + j))
            .when(usable & (j > 1.1 * high), (j - 1.1 * high) / (high + j))
            .otherwise(0.0)
        )
        bound = bound + weights.price * share
    return bound


def _bundled(tiles: DataFrame, rows: int, *order: Column) -> DataFrame:
    """Number the candidate parts of a query part in bundles of about ``rows``
    products, so that many small parts are compared in one go."""
    upto = Window.partitionBy("category_id", "query_part").orderBy(*order, "candidate_part")
    before = F.sum("n_candidates").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_candidates")
    return tiles.withColumn("bundle", F.floor(before / rows).cast("int"))


def _sure_batches(shared, weights: Weights, scalars: list[str]):
    """What the bounds ask of every query: its distances to the pivots, and the score it is sure of."""

    def result(_: tuple, part: Nearest) -> Iterator[pa.RecordBatch]:
        sure, names = part.sure(), [*QUERY_PART, *scalars]
        for start in range(0, len(sure), SURE_ROWS):
            rows = part.queries.slice(start, SURE_ROWS)
            norms, reaches = _reaches(rows, weights, shared.value)
            offsets = np.arange(0, reaches.size + 1, reaches.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c).combine_chunks() for c in names), pa.array(norms),
                 pa.ListArray.from_arrays(offsets, reaches.ravel()), sure.slice(start, SURE_ROWS)],
                names=[*names, "norm", "reaches", "sure"],
            )

    return result


def pruned_search(
    features: DataFrame, candidates: DataFrame, large: DataFrame, search: Search, row_bytes: int, schema: T.StructType
) -> DataFrame | None:
    """The best ``k`` units of every query in the ``large`` categories (``category_id,
    candidate_parts``), or None when the bounds rule out too little to be worth their finer cut.
    Distances to pivots, which are longer than the vectors, are worked out where they are read."""
    spark, weights = features.sparkSession, search.weights
    wanted = F.least(F.lit(MAX_PIVOTS), 16 * F.col("candidate_parts"))
    large = large.select("category_id", wanted.alias("pivots"))
    count = large.agg(F.max("pivots")).first()[0]
    members = features.join(large, "category_id", "left_semi")
    shared = spark.sparkContext.broadcast(_choose_pivots(members, weights, count))

    names = features.columns
    cells = lambda side, name: materialise(_assign_cells(side.select(*names), large, shared, weights), name)
    q = _cut_cells(cells(features, "query-cells"), weights, search.rows, "query_part")
    c = _cut_cells(cells(candidates, "candidate-cells"), weights, search.rows, "candidate_part", SHELLS)
    compared = [n for n in names if n != "category_id"]
    queries, others = q.select("category_id", "query_part", *compared), c.select("category_id", "candidate_part", *compared)
    q_parts = materialise(
        q.groupBy("category_id", "query_part", "cell").agg(F.count(F.lit(1)).alias("n_queries")), "query-parts"
    )
    parts = q_parts.count()
    facts = materialise(_part_facts(c, weights), "part-facts")

    def compare(tiles: DataFrame, waves: int, kernel, schema: T.StructType, kept=lambda rows: rows) -> DataFrame:
        """Run the listed tiles: a query part against candidate parts."""
        right = others.join(kept(tiles).select(*QUERY_PART, "candidate_part"), ["category_id", "candidate_part"])
        return search_parts(kept(queries), right, task_count(spark, -(-parts // waves)), kernel, schema)

    # first pass: every query part with one bundle of its own cell, inner shells first
    inside = q_parts.join(
        facts.select("category_id", F.col("candidate_cell").alias("cell"), "candidate_part", "candidate_shell", "n_candidates"),
        ["category_id", "cell"],
    )
    own = _bundled(inside, search.rows, F.col("candidate_shell")).where("bundle = 0")
    scalars = [n for n, w in (("brand", weights.brand), ("price_hint", weights.price)) if w]
    kinds = {f.name: f.dataType for f in q.schema}
    vector = T.ArrayType(T.DoubleType())
    sure_schema = T.StructType(
        [T.StructField(n, kinds[n]) for n in (*QUERY_PART, *scalars)]
        + [T.StructField("norm", T.DoubleType()), T.StructField("reaches", vector), T.StructField("sure", T.DoubleType())]
    )
    sure = compare(
        materialise(own.select(*QUERY_PART, "candidate_part"), "own-tiles"), 1,
        nearest_batches(search, _sure_batches(shared, weights, scalars)), sure_schema,
    )

    # second pass: parts that some query of a part cannot rule out. There is at most one part
    # per shell of a cell, and one per tile of candidates: a small table beside theirs
    open_ = F.col("sure").isNull() | (least_distance(weights) <= 1 - F.col("sure") + 10.0**-search.digits + SLACK)
    left_open = (
        sure.join(F.broadcast(facts), "category_id")
        .where(open_)
        .groupBy("category_id", "query_part", "candidate_part")
        .agg(F.first("n_candidates").alias("n_candidates"))
        .join(q_parts.select("category_id", "query_part", "n_queries"), ["category_id", "query_part"])
    )
    tiles = materialise(left_open, "tiles")
    work = F.sum(F.col("n_queries").cast("double") * F.col("n_candidates"))
    compared_pairs, copies = tiles.agg(work, F.sum("n_candidates")).first()
    total = (
        q_parts.groupBy("category_id").agg(F.sum("n_queries").alias("n_queries"))
        .join(facts.groupBy("category_id").agg(F.sum("n_candidates").alias("n_candidates")), "category_id")
    )
    if (compared_pairs or 0.0) > WORTHWHILE * (total.agg(work).first()[0] or 0.0):
        return None
    kernel = nearest_batches(search, found_batches)
    return in_waves(copies or 0, row_bytes, lambda kept, waves: compare(tiles, waves, kernel, schema, kept))
