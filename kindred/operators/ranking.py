"""Exact order statistics and ranks that do not funnel a group through one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_key(key: Column, spread_by: Column) -> Column:
    """``key`` for a left join, with nulls spread out.

    Null keys never match but would all hash to one partition; each gets its own
    unmatched value instead.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), spread_by.cast("string")))


def top_per_key(
    df: DataFrame, key: str, order: list[Column], limit: int, salt_by: str, rank: str, salts: int = 32
) -> DataFrame:
    """The first ``limit`` rows per ``key`` and their 1-based ``rank``.

    Exact: a row among the first ``limit`` of its key is also among the first
    ``limit`` of its salt, so each salt is cut before the key is brought
    together. The last step sees at most ``salts * limit`` rows per key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    first = Window.partitionBy(key, "_salt").orderBy(*order)
    cut = salted.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= limit).drop("_salt")
    final = Window.partitionBy(key).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= limit)


def geometric_weight(rank0: Column, ini: float = 0.95) -> Column:
    """Weight of a 0-based rank."""
    return F.pow(F.lit(ini), rank0)


def geometric_cutoff(ini: float = 0.95) -> int:
    """Number of ranks whose weight is not exactly zero in double precision."""
    if not 0 < ini < 1:
        raise ValueError("the rank weight must be between 0 and 1")
    return math.floor((math.log(5e-324) - math.log(2)) / math.log(ini)) + 8


def median(df: DataFrame, column: str, accuracy: int = 100_000, max_values: int = 100_000) -> DataFrame:
    """Exact median of the non-null values as a one-row frame ``median``.

    A quantile sketch brackets the middle (its rank error is at most
    ``1 / accuracy``, the bracket is ten times wider), and the bracket is narrowed
    by sketches of its own rows until it holds ``max_values`` rows at most or
    cannot shrink, which is when ties fill it. Values below the bracket are only
    counted; one task orders the distinct values inside it. Every step is an
    aggregate with map-side parts, and the driver holds two ends and two counts.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    slack = min(0.5, 10 / accuracy)
    ends = lambda rows, at: rows.agg(
        F.percentile_approx("v", [max(0.0, at[0] - slack), min(1.0, at[1] + slack)], accuracy).alias("q"),
        F.count("v").alias("n"),
    ).first()
    bracket, n = ends(values, (0.5, 0.5))
    if not n:
        return values.agg(F.max("v").cast("double").alias("median"))
    places = (n + 1) // 2, (n + 2) // 2
    while True:
        low, high = bracket
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        below, held = values.agg(F.count_if(F.col("v") < low), F.count_if((F.col("v") >= low) & (F.col("v") <= high))).first()
        if held <= max_values or low == high:
            break
        narrower, _ = ends(inside, [(place - below) / held for place in places])
        if narrower == bracket:
            break
        bracket = narrower
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    placed = counted.withColumn("last", F.sum("c").over(upto) + F.lit(below)).withColumn("first", F.col("last") - F.col("c") + 1)
    at = lambda place: F.max(F.when((F.col("first") <= place) & (place <= F.col("last")), F.col("v")))
    return placed.agg(((at(F.lit(places[0])) + at(F.lit(places[1]))) / 2).alias("median"))
