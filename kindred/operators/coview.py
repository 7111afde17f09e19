"""Scoring a ranking against observed co-view pairs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.distance import Weights, blended_distance
from kindred.operators.catalog import candidates as candidate_rows
from kindred.operators.neighbours import comparison_features, row_bytes
from kindred.operators.ranking import geometric_cutoff, geometric_weight, top_per_key
from kindred.operators.tiles import build_grid, rank_kernel
from kindred.session import materialise, unbroadcast


def best_coview(pairs: DataFrame, roles: DataFrame) -> DataFrame:
    """``x, y, score``: best score per product and *primary* co-viewed product.

    Pairs without a score or with an unknown product are dropped; only ``y`` is
    replaced by its primary. Repeated pairs are combined before any join.
    """
    distinct = (
        pairs.where(F.col("ggXY").isNotNull())
        .groupBy("skuX", "skuY")
        .agg(F.max("ggXY").alias("score"))
    )
    primary = roles.select(F.col("sku_id").alias("skuY"), F.col("primary_sku_id").alias("y"))
    return (
        distinct.join(unbroadcast(roles.select(F.col("sku_id").alias("skuX"))), "skuX", "left_semi")
        .join(unbroadcast(primary), "skuY")
        .groupBy(F.col("skuX").alias("x"), "y")
        .agg(F.max("score").alias("score"))
    )


def coview_weights(best: DataFrame, ini: float = 0.95, rank_by: str = "score") -> DataFrame:
    """``x, y, w_y``: the score replaced by the weight of its rank per product.

    ``rank_by='score'`` ranks by score, then id. ``'id_char2'`` ranks by the
    second character of the id, as the established job does. Ranks whose weight
    is exactly 0.0 add nothing to any sum and are left out.
    """
    if rank_by == "score":
        order = [F.desc("score"), F.col("y")]
    elif rank_by == "id_char2":
        order = [F.desc(F.substring("y", 2, 1)), F.col("y")]
    else:
        raise ValueError(f"unknown rank_by {rank_by!r}")
    ranked = top_per_key(best, "x", order, geometric_cutoff(ini), salt_by="y", rank="rank")
    weight = geometric_weight(F.col("rank") - 1, ini)
    return ranked.select("x", "y", weight.alias("w_y")).where("w_y > 0")


def candidate_ranks(
    products: DataFrame,
    weighted: DataFrame,
    weights: Weights | Mapping[str, float] | None = None,
    digits: int = 9,
    null_safe_brand: bool = False,
    exclude_self: bool = False,
    tile_rows: int | None = None,
) -> DataFrame:
    """``x, y, w_y, rank0``: 0-based place of ``y`` among the candidates of the
    category of ``x``, by distance, then id.

    ``products`` carry roles and features. Only co-viewed products are queries
    and only asked ranks are counted: a candidate adds one when it comes before
    ``y``, which sums over tiles. A ``y`` outside the category is left out.
    """
    w = Weights.of(weights)
    features = materialise(
        comparison_features(products, w, id_col="sku_id", extra=("role",)), "rank-features"
    )
    candidates = candidate_rows(features).drop("role", "pos", "group_id")
    side = lambda name: unbroadcast(features).select(
        F.col("id").alias(name),
        F.col("category_id").alias(f"{name}_category"),
        F.struct(*w.columns()).alias(name + "_features"),
        F.col("role").alias(f"{name}_role"),
    )
    distance = blended_distance(
        lambda c: F.col(f"y_features.{c}"), lambda c: F.col(f"x_features.{c}"), w, null_safe_brand
    )
    asked = weighted.join(side("x"), "x").join(
        side("y").where("y_role != 'secondary'"), "y"
    ).where("x_category = y_category")
    if exclude_self:
        asked = asked.where("x != y")
    targets = (
        asked.select("x", F.struct(F.col("y").alias("id"), F.rint(distance * 10**digits).alias("distance"), F.col("w_y").alias("weight")).alias("t"))
        .groupBy("x")
        .agg(F.collect_list("t").alias("targets"))  # at most as many as weights above zero
    )
    queries = materialise(
        features.drop("role", "pos", "group_id").join(unbroadcast(targets.withColumnRenamed("x", "id")), "id"), "rank-queries"
    )
    grid = build_grid(queries, candidates, row_bytes(features, w), tile_rows)
    id_type = features.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("x", id_type),
            T.StructField("y", id_type),
            T.StructField("w_y", T.DoubleType()),
            T.StructField("ahead", T.LongType()),
        ]
    )
    counted = grid.apply(rank_kernel(w, digits, null_safe_brand, exclude_self), schema)
    if grid.single_pass:
        return counted.withColumnRenamed("ahead", "rank0")
    return counted.groupBy("x", "y", "w_y").agg(F.sum("ahead").alias("rank0"))


def score_per_query(weighted: DataFrame, ranks: DataFrame, ini: float = 0.95) -> DataFrame:
    """``x, weight_sum, full_sum`` for every co-viewed product. A neighbour that
    is not ranked, or ranked so low that its weight is zero, adds to neither."""
    s_y = geometric_weight(F.col("rank0"), ini)
    sums = (
        ranks.withColumn("s_y", s_y)
        .where("s_y > 0")
        .groupBy("x")
        .agg(F.sum(F.col("w_y") * F.col("s_y")).alias("weight_sum"), F.sum(F.col("w_y") * F.col("w_y")).alias("full_sum"))
    )
    return (
        weighted.select("x").distinct()
        .join(unbroadcast(sums), "x", "left")
        .select("x", F.coalesce("weight_sum", F.lit(0.0)).alias("weight_sum"), F.coalesce("full_sum", F.lit(0.0)).alias("full_sum"))
    )


def coview_ratio(per_query: DataFrame) -> DataFrame:
    """One row: ratio of the sums (not the mean of ratios)."""
    return per_query.agg(F.try_divide(F.sum("weight_sum"), F.sum("full_sum")).alias("ratio"))
