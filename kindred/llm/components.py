"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``) but the smallest of each component.

    ``component`` is the smallest node that can be reached. Each round hangs the
    larger neighbours of every node, then all its smaller ones, on the smallest;
    links per round never grow. Loops and null ends are dropped. Minima are
    combined before the shuffle; the joins are left to adaptive skew handling.
    Every round is written to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links, state = _settled(links)
    while state[0]:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, now = _settled(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _settled(links: DataFrame) -> tuple[DataFrame, tuple]:
    links = materialise(links, "links")
    return links, tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def local_stars(adjacent: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric boolean matrix, the first row of its component."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        seen = np.where(adjacent, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, seen)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
