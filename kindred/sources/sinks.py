"""Outputs: recommendation pairs, catalog export, snapshots, metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_AVAILABLE = "N/A"


def recommendation_lines(recommendations: DataFrame) -> DataFrame:
    """One JSON object per row; a product without candidates shows ``N/A`` for
    both neighbour and score."""
    missing = F.lit(NOT_AVAILABLE)
    found = F.to_json(F.struct("idX", "idY", "score", "method"))
    alone = F.to_json(F.struct("idX", missing.alias("idY"), missing.alias("score"), "method"))
    return recommendations.select(F.when(F.col("idY").isNull(), alone).otherwise(found).alias("value"))


def write_recommendations(recommendations: DataFrame, path: str, format: str = "json") -> None:
    """JSON lines as above, or any columnar ``format`` with a nullable score."""
    if format == "json":
        recommendation_lines(recommendations).write.text(path)
    else:
        recommendations.write.format(format).save(path)


def export_columns(catalog: DataFrame) -> DataFrame:
    """The product attributes shown next to recommendations."""
    return catalog.select("id", "brand", "image_url", "title", F.col("category_id").alias("node_id"))


def write_catalog_export(catalog: DataFrame, path: str) -> None:
    export_columns(catalog).write.option("ignoreNullFields", False).json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Keep a relation (co-view pairs, word vectors, ...) for later runs."""
    df.write.parquet(path)


def write_word_vectors(words: DataFrame, path: str) -> None:
    """``word v1 .. vd`` text lines, readable by ``read_word_vectors``."""
    numbers = F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")
    words.select(F.concat_ws(" ", "word", numbers).alias("value")).write.text(path)
