"""Best neighbours of every product inside its category."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.distance import Weights
from kindred.operators.pruning import can_prune, pruned_search
from kindred.operators.tiles import Search, build_grid, search_all, shortlist_kernel
from kindred.session import materialise


def comparison_features(
    products: DataFrame, weights: Weights, id_col: str = "id", position: str = "sku_id", extra: tuple = ()
) -> DataFrame:
    """Only the columns a comparison reads; products without a category drop out."""
    return products.where(F.col("category_id").isNotNull()).select(
        F.col(id_col).alias("id"),
        F.col(position).alias("pos"),
        "group_id",
        "category_id",
        *weights.columns(),
        *extra,
    )


def row_bytes(features: DataFrame, weights: Weights) -> int:
    """Bytes of one product's vectors, from the first row."""
    widths = features.select(*(F.size(v).alias(v) for v in weights.vectors())).first()
    return 8 * sum(widths) if widths else 8


def without_surplus_copies(features: DataFrame, weights: Weights, k: int) -> DataFrame:
    """Candidates that can still reach a top ``k``.

    Products equal in everything compared are equally similar to any query, so of
    ungrouped copies only the ``k + 1`` highest ids, and of copies in one group
    only the two first members, can ever be returned (one of them may be the
    query itself). Only classes seen more than twice as often as that are shuffled.
    """
    same = ["category_id", "group_id", *weights.columns()]
    hashed = features.withColumn("_class", F.xxhash64(*same))
    needed = F.when(F.bool_or(F.col("group_id").isNull()), k + 1).otherwise(2)
    crowded = materialise(
        hashed.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), needed.alias("needed")).where("n > 2 * needed").select("_class"),
        "crowded",
    )
    if crowded.isEmpty():
        return features
    rest = hashed.join(crowded, "_class", "left_anti")
    alone = F.col("group_id").isNull()
    order = Window.partitionBy("_class", *same).orderBy(F.when(~alone, F.col("pos")), F.desc("id"))
    kept = (
        hashed.join(crowded, "_class", "left_semi")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= k + 1)
        .where(alone | (F.col("_n") <= 2))
        .drop("_n")
    )
    return materialise(rest.unionByName(kept).drop("_class"), "candidates")


def lonely_products(features: DataFrame) -> DataFrame:
    """Products that are the only one of their category."""
    return (
        features.groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"))
        .where("n = 1")
        .select("id")
    )


def top_neighbours(
    products: DataFrame,
    weights: Weights | Mapping[str, float] | None = None,
    k: int = 48,
    method: str = "tfidf_word2vec",
    digits: int = 9,
    position: str = "sku_id",
    null_safe_brand: bool = False,
    tile_rows: int | None = None,
    prune: bool = True,
) -> DataFrame:
    """``idX, idY, score, method``: at most ``k`` neighbours per product.

    Each group counts once, by its best member (first by ``position`` on a tie);
    the query's own group siblings compete, the query itself does not. Results
    are ordered by score, then id, descending. Similarities are rounded to
    ``digits`` before they are compared, which keeps ties the same on any
    cluster. Categories larger than a tile are searched with bounds unless
    ``prune`` is off; the result is the same. A product alone in its category gets one row with null ``idY``.
    """
    w = Weights.of(weights)
    features = materialise(comparison_features(products, w, position=position), "features")
    width = row_bytes(features, w)
    candidates = without_surplus_copies(features, w, k)
    grid = build_grid(features, candidates, width, tile_rows)
    kind = {f.name: f.dataType for f in features.schema}
    pair = [T.StructField("idX", kind["id"]), T.StructField("idY", kind["id"])]
    score = T.StructField("score", T.DoubleType())
    columns = ["idX", "idY", "score"]
    listed = T.StructType([*pair, T.StructField("group_id", kind["group_id"]), T.StructField("pos", kind["pos"]), score])
    # where one tile sees the whole category, its cut is the result
    final = shortlist_kernel(k, w, digits, null_safe_brand, final=True)
    if grid.single_pass:
        found = grid.apply(final, listed).select(*columns)
    else:
        # in larger categories candidates pass by their queries, which needs no merge
        several = grid.large.where("candidate_parts > 1")
        search, schema, found = Search(w, k, digits, null_safe_brand, grid.candidate_rows), T.StructType([*pair, score]), None
        if prune and can_prune(w):
            found = pruned_search(features, candidates, several, search, width, schema)
        if found is None:
            found = search_all(features, candidates, several, search, width, schema)
        found = found.unionByName(grid.without(several).apply(final, listed).select(*columns))
    alone = lonely_products(features).select(
        F.col("id").alias("idX"), F.lit(None).cast(kind["id"]).alias("idY"), F.lit(None).cast("double").alias("score")
    )
    return found.unionByName(alone).withColumn("method", F.lit(method))
