"""Evaluation job: how well the ranking puts co-viewed products first."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kindred.operators.catalog import normalise_catalog, require_unique, with_roles
from kindred.operators.coview import best_coview, candidate_ranks, coview_ratio, coview_weights, score_per_query
from kindred.plans.recommend import Model, select_products, with_features
from kindred.session import materialise


def evaluate_per_query(
    raw_catalog: DataFrame,
    pairs: DataFrame,
    model: Model = Model(),
    words: DataFrame | None = None,
    images: DataFrame | None = None,
    document_vectors: DataFrame | None = None,
    ini: float = 0.95,
    rank_by: str = "score",
    exclude_self: bool = False,
    tile_rows: int | None = None,
) -> DataFrame:
    """``x, weight_sum, full_sum`` for ``pairs`` (``skuY, skuX, ggXY``)."""
    catalog = require_unique(materialise(normalise_catalog(raw_catalog), "catalog"), "id")
    products = require_unique(select_products(catalog, model, words, images), "sku_id")
    featured = materialise(with_roles(with_features(products, model, words, document_vectors)), "featured")
    weighted = materialise(
        coview_weights(best_coview(pairs, featured.select("sku_id", "primary_sku_id")), ini, rank_by), "coview"
    )
    ranks = candidate_ranks(
        featured, weighted, model.weights, model.digits, model.null_safe_brand, exclude_self, tile_rows
    )
    return score_per_query(weighted, ranks, ini)


def evaluate(raw_catalog: DataFrame, pairs: DataFrame, *args, **options) -> DataFrame:
    """One row ``ratio``; see :func:`evaluate_per_query` for the arguments."""
    return coview_ratio(evaluate_per_query(raw_catalog, pairs, *args, **options))
