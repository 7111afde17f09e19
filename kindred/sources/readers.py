"""Inputs: catalogs, image vectors, word vectors, co-view pairs, name maps, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME_MAP = T.MapType(T.StringType(), T.StringType())

CATALOG_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sku_id", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price_hint", T.StringType()),
        T.StructField("main_image", T.StructType([T.StructField("raw", T.StringType())])),
        T.StructField(
            "elasticsearch_result",
            T.StructType(
                [T.StructField("products", NAME_MAP), T.StructField("parentProducts", NAME_MAP)]
            ),
        ),
    ]
)

IMAGE_RECORD = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("prelogits", T.ArrayType(T.DoubleType()))]
)

COVIEW_COLUMNS = ("skuX", "skuY", "nodeX", "nodeY", "ggXY")


def read_json_records(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, array_files: bool = True
) -> DataFrame:
    """Read JSON with a fixed schema. ``array_files`` means each file holds one
    array of records (a file is then one task); otherwise one record per line,
    which Spark can split and which is the better layout for big files."""
    return spark.read.schema(schema).option("multiLine", array_files).option("mode", "FAILFAST").json(paths)


def product_strings(products: Column, parents: Column) -> tuple[Column, Column]:
    """(products, parentProducts) strings from two arrays of names.

    Names are sorted and joined by ``and``; names that are also parents are left
    out of the products. Without parents the parent string is null, and without
    any name so is the product string.
    """
    products = F.array_distinct(F.coalesce(products, F.array().cast("array<string>")))
    parents = F.array_distinct(F.coalesce(parents, F.array().cast("array<string>")))
    has_parent = F.size(parents) > 0
    joined = lambda names: F.array_join(F.array_sort(names), " and ")
    return (
        F.when(has_parent, joined(F.array_except(products, parents)))
        .when(F.size(products) > 0, joined(products)),
        F.when(has_parent, joined(parents)),
    )


def catalog_columns(records: DataFrame) -> DataFrame:
    """The ten catalog columns of raw records; everything else is dropped."""
    names = "elasticsearch_result.products", "elasticsearch_result.parentProducts"
    products, parents = product_strings(*(F.map_keys(F.col(n)) for n in names))
    return records.select(
        products.alias("products"),
        parents.alias("parentProducts"),
        "brand",
        "price_hint",
        "title",
        "category_id",
        "group_id",
        "id",
        "sku_id",
        F.col("main_image.raw").alias("image_url"),
    )


def read_catalog(spark: SparkSession, paths: str | list[str], array_files: bool = True) -> DataFrame:
    """Catalog JSON; price stays text until the catalog is normalised."""
    return catalog_columns(read_json_records(spark, paths, CATALOG_RECORD, array_files))


def read_image_vectors(
    spark: SparkSession, paths: str | list[str], array_files: bool = True
) -> DataFrame:
    """Image vectors as ``id, prelogits array<double>``."""
    return read_json_records(spark, paths, IMAGE_RECORD, array_files)


def read_word_vectors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text vectors ``word v1 .. vd`` as ``word, vec``; a header of two whole numbers is skipped."""
    parts = F.split(F.rtrim("value"), " ")
    return (
        spark.read.text(path)
        .select(parts.alias("p"))
        .where((F.size("p") > 1) & ~F.rtrim("value").rlike(r"^\d+ \d+$"))
        .select(
            F.element_at("p", 1).alias("word"),
            F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vec"),
        )
    )


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``from => to``; the later line wins, and a line without an arrow fails.

    The line order inside a file comes from the block offset and the row number
    in the split, so a map is expected to be one file.
    """
    parts = F.split("value", "=>")
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    arrow = F.when(F.size(parts) > 1, trim(F.element_at(parts, 2))).otherwise(
        F.raise_error(F.concat(F.lit("no '=>' in line: "), "value"))
    )
    return (
        spark.read.text(path)
        .select(
            trim(F.element_at(parts, 1)).alias("from"),
            arrow.alias("to"),
            F.struct(
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id(),
            ).alias("line"),
        )
        .groupBy("from")
        .agg(F.max_by("to", "line").alias("to"))
    )


def coview_pairs(pairs: DataFrame, node_prefix: str) -> DataFrame:
    """Scored pairs inside one node whose id starts with ``node_prefix``.

    A plain filter and projection: over parquet or JDBC Spark pushes it down.
    """
    return pairs.where(
        F.col("nodeX").startswith(node_prefix)
        & F.col("nodeY").startswith(node_prefix)
        & (F.col("nodeX") == F.col("nodeY"))
    ).select("skuY", "skuX", "ggXY")


def read_coview(
    spark: SparkSession,
    source: str,
    node_prefix: str,
    table: str | None = None,
    jdbc_options: dict[str, str] | None = None,
) -> DataFrame:
    """Co-view pairs from a parquet folder, or from ``table`` of a JDBC ``source``.

    Pass ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions`` in
    ``jdbc_options`` so that a big table is not read by one task.
    """
    if table is None:
        pairs = spark.read.parquet(source)
    else:
        pairs = spark.read.jdbc(source, table, properties=jdbc_options or {})
    return coview_pairs(pairs.select(*COVIEW_COLUMNS), node_prefix)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`kindred.sources.sinks.write_snapshot`."""
    return spark.read.parquet(path)


def corpus_tokens(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whitespace tokens of every document as ``doc, tokens``."""
    return corpus.select(
        F.col(id_col).alias("doc"),
        F.filter(F.split(F.trim(text_col), r"\s+"), lambda t: t != "").alias("tokens"),
    )


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document per line. The document id is file, split and line in split,
    so it is the same on every read of the same files."""
    lines = spark.read.text(path).select(
        "value",
        F.concat_ws(
            ":",
            F.col("_metadata.file_name"),
            F.col("_metadata.file_block_start").cast("string"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("string"),
        ).alias("doc"),
    )
    return corpus_tokens(lines, "doc", "value")
