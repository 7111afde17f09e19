"""The test tables in the roles of a catalog, word vectors, images and co-views.

Each role exists twice: as a DataFrame here and as a common table expression in
``PRELUDE`` for the SQL side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.session import unbroadcast
from kindred.sources.readers import product_strings

LINES_PER_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table with rows in at least one partition per core. One small file is
    read as one partition and a larger one by its row groups, which may leave most
    partitions empty; cleaning costs far more than moving the text. A table of many
    files is used as it is."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    partitions = rows.rdd.getNumPartitions()
    if partitions >= cores and rows.select(F.spark_partition_id()).distinct().count() >= cores:
        return rows
    return rows.repartition(max(cores, partitions))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a raw catalog: text prices with gaps, groups of any size."""
    names = F.split("p_name", " ")
    parents = F.when(F.col("p_type") != "PROMO", F.array(F.element_at(names, -1)))
    products, parent_products = product_strings(names, parents)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("S"), "p_partkey").alias("sku_id"),
        F.concat_ws("|", "p_type", "p_brand", "p_size").alias("group_id"),
        F.col("p_type").alias("category_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") <= 43, F.col("p_retailprice")).cast("string").alias("price_hint"),
        products.alias("products"),
        parent_products.alias("parentProducts"),
        F.concat(F.lit("img/"), "p_partkey").alias("image_url"),
    )


def catalog_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with missing titles, brands and categories, and with categories of one product."""
    n = F.col("id").cast("long")
    gap = lambda divisor, column: F.when(n % divisor != 0, F.col(column))
    category = F.when(n % 97 == 1, F.concat(F.lit("only-"), "id")).otherwise(gap(41, "category_id"))
    return catalog(spark, sf_dir).withColumns(
        {"title": gap(37, "title"), "brand": gap(5, "brand"), "category_id": category}
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("prelogits")
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th distinct word of the part names gets the n-th embedding."""
    distinct = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    numbered = distinct.withColumn("vec_id", F.row_number().over(Window.orderBy("word")).cast("long") - 1)
    return numbered.join(table(spark, sf_dir, "embeddings"), "vec_id").select(
        "word", F.col("embedding").cast("array<double>").alias("vec")
    )


def part_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(``id, tokens``: the parts each customer ordered; ``word, vec``: all embeddings).

    Parts share the words round robin when there are more of them than vectors.
    """
    vectors = table(spark, sf_dir, "embeddings")
    words = vectors.select(
        F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("vec")
    )
    n = vectors.select(F.count(F.lit(1)).alias("n")).scalar()
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("w"), F.col("l_partkey") % n).alias("word"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    return lines.join(orders, "l_orderkey").groupBy("id").agg(F.collect_list("word").alias("tokens")), words


def dealer(spark: SparkSession, sf_dir: str) -> Callable[..., DataFrame]:
    """Deals order lines or pairs by keys to tasks that grow in number with the lines and not in
    size, where the session's number of partitions is too small. Pairs are distinct, so that
    a product has no more of them than there are products."""
    tasks = -(-table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)
    many = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lambda rows, *keys: rows.repartition(tasks, *keys) if many else rows


def coview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line seen together with the lead product of its order, in both
    directions: two rows per line however large the order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    deal = dealer(spark, sf_dir)
    lines = deal(lines, "l_orderkey")
    leads = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("lead"))
    seen = lines.join(unbroadcast(leads), "l_orderkey").where("l_partkey <> lead")
    ends = F.array(
        F.struct(F.col("l_partkey").alias("x"), F.col("lead").alias("y")),
        F.struct(F.col("lead").alias("x"), F.col("l_partkey").alias("y")),
    )
    directed = seen.select(F.explode(ends).alias("p"), "l_quantity").select("p.x", "p.y", "l_quantity")
    pairs = (
        deal(directed, "x", "y")
        .groupBy("x", "y")
        .agg(F.nullif(F.sum("l_quantity"), F.lit(50.0)).alias("ggXY"))
    )
    node = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    end = lambda e: unbroadcast(node).select(F.col("p_partkey").alias(e), F.col("p_type").alias(f"node{e.upper()}"))
    return deal(deal(pairs, "x").join(end("x"), "x"), "y").join(end("y"), "y").select(
        F.concat(F.lit("S"), "x").alias("skuX"), F.concat(F.lit("S"), "y").alias("skuY"), "nodeX", "nodeY", "ggXY"
    )


PRELUDE = """
WITH raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, 'S' || p_partkey AS sku_id,
         p_type || '|' || p_brand || '|' || p_size AS group_id, p_type AS category_id,
         p_name AS title, p_brand AS brand,
         CASE WHEN p_size <= 43 THEN p_retailprice END AS price_hint,
         list_sort(list_distinct(string_split(p_name, ' '))) AS names,
         CASE WHEN p_type <> 'PROMO' THEN string_split(p_name, ' ')[-1] END AS parent,
         'img/' || p_partkey AS image_url
  FROM part),
catalog AS (
  SELECT id, sku_id, category_id, title, brand, image_url,
         CASE WHEN count(*) OVER (PARTITION BY group_id) > 1 THEN group_id END AS group_id,
         coalesce(price_hint, (SELECT median(price_hint) FROM raw)) AS price_hint,
         CASE WHEN parent IS NULL THEN array_to_string(names, ' and ')
              ELSE coalesce(array_to_string(list_filter(names, lambda n: n <> parent), ' and '), '') END AS products,
         parent AS "parentProducts"
  FROM raw),
roles AS (
  SELECT *, CASE WHEN group_id IS NULL THEN sku_id
                 ELSE min(sku_id) OVER (PARTITION BY group_id) END AS primary_sku_id
  FROM catalog),
images AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS prelogits FROM embeddings),
words AS (
  SELECT word, CAST(embedding AS DOUBLE[]) AS vec
  FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS n
        FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part))
  JOIN embeddings ON vec_id = n),
title_words AS (
  SELECT id, word FROM (SELECT id, unnest(string_split(title, ' ')) AS word FROM catalog)
  WHERE word IN (SELECT word FROM words)),
dims AS (SELECT unnest(range(1, (SELECT max(len(vec)) FROM words) + 1)) AS i),
word_df AS (SELECT word, count(DISTINCT id) AS df FROM title_words GROUP BY word),
tfidf_sum AS (
  SELECT id, i, sum(vec[i] * ln((SELECT count(DISTINCT id) FROM title_words) / df)) AS s
  FROM title_words JOIN words USING (word) JOIN word_df USING (word), dims GROUP BY id, i),
tfidf_vec AS (
  SELECT id, list(s ORDER BY i) AS s, sqrt(sum(s * s)) AS norm FROM tfidf_sum GROUP BY id),
title_vecs AS (
  SELECT id, list_transform(s, lambda x: CASE WHEN norm = 0 THEN x ELSE x / norm END) AS title_vec FROM tfidf_vec),
mean_sum AS (
  SELECT id, i, avg(vec[i]) AS s FROM title_words JOIN words USING (word), dims GROUP BY id, i),
mean_vecs AS (
  SELECT id, list_transform(list(s ORDER BY i), lambda x: x / sqrt(sum(s * s))) AS title_vec
  FROM mean_sum GROUP BY id),
product_words AS (
  SELECT id, word FROM (SELECT id, unnest(regexp_split_to_array(products, ' and |\\s')) AS word FROM catalog)
  WHERE word IN (SELECT word FROM words)),
product_sum AS (
  SELECT id, i, avg(vec[i]) AS s FROM product_words JOIN words USING (word), dims GROUP BY id, i),
product_vecs AS (
  SELECT id, list_transform(list(s ORDER BY i), lambda x: x / sqrt(sum(s * s))) AS product_vec
  FROM product_sum GROUP BY id),
image_vecs AS (
  SELECT id, list_transform(prelogits, lambda x: x / sqrt(list_dot_product(prelogits, prelogits))) AS image_vec
  FROM images),
leads AS (SELECT l_orderkey, min(l_partkey) AS lead FROM lineitem GROUP BY l_orderkey),
seen AS (
  SELECT l_partkey, lead, l_quantity FROM lineitem JOIN leads USING (l_orderkey) WHERE l_partkey <> lead),
coview_sum AS (
  SELECT x, y, nullif(sum(l_quantity), 50) AS g
  FROM (SELECT l_partkey AS x, lead AS y, l_quantity FROM seen
        UNION ALL SELECT lead, l_partkey, l_quantity FROM seen) GROUP BY x, y),
coview AS (
  SELECT 'S' || x AS "skuX", 'S' || y AS "skuY", a.p_type AS "nodeX", b.p_type AS "nodeY", g AS "ggXY"
  FROM coview_sum JOIN part a ON a.p_partkey = x JOIN part b ON b.p_partkey = y),
coview_in_node AS (
  SELECT "skuX", "skuY", "ggXY" FROM coview WHERE "nodeX" = "nodeY"),
best AS (
  SELECT "skuX" AS x, primary_sku_id AS y, max("ggXY") AS score
  FROM coview_in_node JOIN roles ON sku_id = "skuY"
  WHERE "ggXY" IS NOT NULL AND "skuX" IN (SELECT sku_id FROM roles) GROUP BY 1, 2),
weighted AS (
  SELECT x, y, pow(0.95, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) - 1) AS w_y FROM best)
"""
