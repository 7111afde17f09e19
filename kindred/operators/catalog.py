"""Catalog preparation: groups, prices, roles, image join, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.ranking import median, spread_key
from kindred.session import unbroadcast

PRIMARY, UNGROUPED, SECONDARY = "primary", "ungrouped", "secondary"


def _with_group_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Left join facts keyed by ``group_id``; null groups are spread, not piled up."""
    keyed = df.withColumn("_key", spread_key(F.col("group_id"), F.col("sku_id")))
    return keyed.join(facts.withColumnRenamed("group_id", "_key"), "_key", "left").drop("_key")


def drop_singleton_groups(df: DataFrame) -> DataFrame:
    """Null the group of products that are alone in it."""
    shared = (
        df.where(F.col("group_id").isNotNull())
        .groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("group_id", F.lit(True).alias("_shared"))
    )
    return _with_group_facts(df, shared).withColumn(
        "group_id", F.when(F.col("_shared"), F.col("group_id"))
    ).drop("_shared")


def fill_median_price(df: DataFrame) -> DataFrame:
    """Cast the price to double (bad text fails) and fill gaps with the median."""
    priced = df.withColumn("price_hint", F.col("price_hint").cast("double"))
    known = F.when(~F.isnan("price_hint"), F.col("price_hint"))
    middle = median(priced.withColumn("price_hint", known), "price_hint")
    return priced.withColumn("price_hint", F.coalesce(known, middle.scalar()))


def normalise_catalog(raw: DataFrame) -> DataFrame:
    """Groups of one removed and prices filled, before any row is filtered."""
    return fill_median_price(drop_singleton_groups(raw))


def group_primaries(df: DataFrame, position: str = "sku_id") -> DataFrame:
    """``group_id, primary_sku_id``: the member that comes first by ``position``."""
    return (
        df.where(F.col("group_id").isNotNull())
        .groupBy("group_id")
        .agg(F.min(F.struct(F.col(position).alias("p"), F.col("sku_id").alias("s"))).alias("m"))
        .select("group_id", F.col("m.s").alias("primary_sku_id"))
    )


def with_roles(df: DataFrame, position: str = "sku_id") -> DataFrame:
    """Add ``primary_sku_id`` (own id when ungrouped) and ``role``."""
    primary = F.coalesce("primary_sku_id", "sku_id")
    role = (
        F.when(F.col("group_id").isNull(), UNGROUPED)
        .when(primary == F.col("sku_id"), PRIMARY)
        .otherwise(SECONDARY)
    )
    return _with_group_facts(df, group_primaries(df, position)).withColumn("role", role).withColumn(
        "primary_sku_id", primary
    )


def candidates(df_with_roles: DataFrame) -> DataFrame:
    """Primaries and ungrouped products: what a co-view query is ranked against."""
    return df_with_roles.where(F.col("role") != SECONDARY)


def secondary_to_primary(df_with_roles: DataFrame) -> DataFrame:
    """``sku_id, primary_sku_id`` of the secondary products."""
    return df_with_roles.where(F.col("role") == SECONDARY).select("sku_id", "primary_sku_id")


def group_members(df: DataFrame, position: str = "sku_id") -> DataFrame:
    """Each primary next to every member of its group, one row per member.

    The relation is kept flat so that a very large group stays spread out.
    """
    return (
        df.where(F.col("group_id").isNotNull())
        .join(group_primaries(df, position), "group_id")
        .select("primary_sku_id", F.col("sku_id").alias("member_sku_id"))
    )


def category_sizes(df: DataFrame) -> DataFrame:
    """Products per category; products without a category take no part."""
    return (
        df.where(F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("n_products"))
    )


def join_images(df: DataFrame, images: DataFrame) -> DataFrame:
    """Keep products that have an image vector, as ``prelogits``."""
    return df.join(unbroadcast(images.select("id", "prelogits")), "id", "inner")


def duplicated(df: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that occur more than once, with their counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early on repeated identifiers (duplicates make rankings ambiguous)."""
    for column in columns:
        examples = [row[0] for row in duplicated(df, column).limit(5).collect()]
        if examples:
            raise ValueError(f"{column} is not unique, for example {examples}")
    return df
