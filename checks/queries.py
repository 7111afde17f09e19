"""One query per operator, over whole test tables.

Every entry is ``name -> (Spark query, SQL)``; the SQL is ``None`` where the
operation cannot be written in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import PRELUDE, table, texts
from kindred.functions import distance as d
from kindred.functions.distance import Weights
from kindred.functions.text import clean_text, product_words
from kindred.functions.vectors import dot, hashed_vector, l2_normalize
from kindred.functions.wordlists import ENGLISH_STOP_WORDS
from kindred.operators import catalog as cat
from kindred.operators import coview as cv
from kindred.operators import embeddings, lsa, quality, terms, titles
from kindred.operators.neighbours import top_neighbours
from kindred.operators.ranking import median
from kindred.plans.evaluate import evaluate_per_query
from kindred.plans.recommend import Model, recommend, select_products, with_features
from kindred.session import materialise, scratch_path, unbroadcast
from kindred.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
DIGITS = 6

DEFAULT = Weights()
BLEND = Weights(title=0.5, image=0.0, brand=0.2, price=0.3)
FULL = Weights(title=0.4, image=0.2, product=0.2, brand=0.1, price=0.1)


def query(sql: str | None = None, prelude: bool = True):
    def register(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, (PRELUDE + sql if prelude else sql) if sql else None)
        return f

    return register


def rounded(value: Column, digits: int = DIGITS) -> Column:
    return F.round(value, digits) + F.lit(0.0)


def elements(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("dim", "v")).select(key, "dim", rounded(F.col("v")).alias("value"))


ELEMENTS_SQL = """
SELECT {key}, CAST(i - 1 AS INTEGER) AS dim, round({vec}[i], 6) + 0.0 AS value
FROM (SELECT {key}, {vec}, unnest(range(1, len({vec}) + 1)) AS i FROM {source})
"""


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return cat.normalise_catalog(fx.catalog(spark, sf))


# --- catalog ---------------------------------------------------------------


@query("SELECT id, group_id FROM catalog")
def singleton_groups(spark, sf):
    return cat.drop_singleton_groups(fx.catalog(spark, sf)).select("id", "group_id")


@query("SELECT id, price_hint FROM catalog")
def price_median_fill(spark, sf):
    return cat.fill_median_price(fx.catalog(spark, sf)).select("id", "price_hint")


@query("SELECT median(l_extendedprice) AS median FROM lineitem", prelude=False)
def exact_median(spark, sf):
    return median(table(spark, sf, "lineitem"), "l_extendedprice")


@query("SELECT group_id, min(sku_id) AS primary_sku_id FROM catalog WHERE group_id IS NOT NULL GROUP BY group_id")
def group_primary(spark, sf):
    return cat.group_primaries(cat.drop_singleton_groups(fx.catalog(spark, sf)))


ROLE_SQL = "CASE WHEN group_id IS NULL THEN 'ungrouped' WHEN sku_id = primary_sku_id THEN 'primary' ELSE 'secondary' END"


@query(f"SELECT sku_id, primary_sku_id, {ROLE_SQL} AS role FROM roles")
def group_roles(spark, sf):
    products = cat.drop_singleton_groups(fx.catalog(spark, sf))
    return cat.with_roles(products).select("sku_id", "primary_sku_id", "role")


@query("SELECT sku_id, primary_sku_id FROM roles WHERE sku_id <> primary_sku_id")
def secondary_to_primary(spark, sf):
    return cat.secondary_to_primary(cat.with_roles(cat.drop_singleton_groups(fx.catalog(spark, sf))))


@query("SELECT primary_sku_id, sku_id AS member_sku_id FROM roles WHERE group_id IS NOT NULL")
def group_members(spark, sf):
    return cat.group_members(cat.drop_singleton_groups(fx.catalog(spark, sf)))


@query("SELECT category_id, count(*) AS n_products FROM catalog GROUP BY category_id")
def category_sizes(spark, sf):
    return cat.category_sizes(fx.catalog(spark, sf))


@query('SELECT id, products, "parentProducts" FROM catalog')
def product_strings(spark, sf):
    return fx.catalog(spark, sf).select("id", "products", "parentProducts")


@query("SELECT id, brand, image_url, title, category_id AS node_id FROM catalog")
def export_catalog(spark, sf):
    return sinks.export_columns(fx.catalog(spark, sf))


@query("SELECT title, count(*) AS n_rows FROM catalog GROUP BY title HAVING count(*) > 1")
def duplicated_titles(spark, sf):
    return cat.duplicated(fx.catalog(spark, sf), "title")


@query("SELECT id, len(prelogits) AS width FROM catalog JOIN images USING (id)")
def image_join(spark, sf):
    return cat.join_images(fx.catalog(spark, sf), fx.images(spark, sf)).select(
        "id", F.size("prelogits").cast("long").alias("width")
    )


# --- sources and sinks -----------------------------------------------------


def _as_records(raw: DataFrame) -> DataFrame:
    ones = lambda names: F.map_from_arrays(names, F.transform(names, lambda _: F.lit("1")))
    names = F.split("title", " ")
    parents = F.when(F.col("category_id") != "PROMO", F.array(F.element_at(names, -1))).otherwise(
        F.array().cast("array<string>")
    )
    return raw.select(
        "id", "sku_id", "group_id", "category_id", "title", "brand", "price_hint",
        F.struct(F.col("image_url").alias("raw")).alias("main_image"),
        F.struct(
            ones(F.array_distinct(names)).alias("products"), ones(parents).alias("parentProducts")
        ).alias("elasticsearch_result"),
    )


CATALOG_ROWS = (
    'SELECT id, sku_id, raw.group_id, category_id, title, brand, raw.price_hint, image_url, '
    'c.products, c."parentProducts" FROM raw JOIN catalog c USING (id, sku_id, category_id, title, brand, image_url)'
)


@query(CATALOG_ROWS)
def catalog_json(spark, sf):
    path = scratch_path(spark, "catalog-json")
    _as_records(fx.catalog(spark, sf)).write.json(path)
    back = readers.read_catalog(spark, path, array_files=False)
    return back.withColumn("price_hint", F.col("price_hint").cast("double"))


def _write_arrays(rows: DataFrame, key: str, path: str, rows_per_file: int = 2_000) -> None:
    """JSON files that hold one array each, of about ``rows_per_file`` records."""
    files = -(-max(rows.count(), 1) // rows_per_file)
    file = F.pmod(F.xxhash64(key), F.lit(files)).alias("file")
    arrays = rows.groupBy(file).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query(CATALOG_ROWS)
def catalog_json_arrays(spark, sf):
    path = scratch_path(spark, "catalog-arrays")
    _write_arrays(_as_records(fx.catalog(spark, sf)), "id", path)
    return readers.read_catalog(spark, path).withColumn("price_hint", F.col("price_hint").cast("double"))


@query(ELEMENTS_SQL.format(key="id", vec="prelogits", source="images"))
def image_json_arrays(spark, sf):
    path = scratch_path(spark, "image-arrays")
    _write_arrays(fx.images(spark, sf), "id", path)
    return elements(readers.read_image_vectors(spark, path), "id", "prelogits")


@query(ELEMENTS_SQL.format(key="id", vec="prelogits", source="images"))
def image_json(spark, sf):
    path = scratch_path(spark, "image-json")
    fx.images(spark, sf).write.json(path)
    return elements(readers.read_image_vectors(spark, path, array_files=False), "id", "prelogits")


@query(ELEMENTS_SQL.format(key="word", vec="vec", source="words"))
def word_vector_text(spark, sf):
    path = scratch_path(spark, "word-vectors")
    sinks.write_word_vectors(fx.words(spark, sf), path)
    return elements(readers.read_word_vectors(spark, path), "word", "vec")


@query('SELECT title AS "from", max(brand) AS "to" FROM catalog GROUP BY title')
def name_map_text(spark, sf):
    path = scratch_path(spark, "name-map")
    lines = fx.catalog(spark, sf).groupBy("title").agg(F.max("brand").alias("brand"))
    lines.select(F.concat_ws(" => ", "title", "brand").alias("value")).write.text(path)
    return readers.read_name_map(spark, path)


@query("""SELECT "skuX", "skuY", "ggXY" FROM coview
WHERE "nodeX" LIKE 'S%' AND "nodeY" LIKE 'S%' AND "nodeX" = "nodeY" """)
def prefix_node_pairs(spark, sf):
    return readers.coview_pairs(fx.coview(spark, sf), "S").select("skuX", "skuY", "ggXY")


@query("""SELECT "skuX", "skuY", "ggXY" FROM coview
WHERE "nodeX" LIKE 'S%' AND "nodeY" LIKE 'S%' AND "nodeX" = "nodeY" """)
def coview_snapshot(spark, sf):
    path = scratch_path(spark, "coview")
    sinks.write_snapshot(fx.coview(spark, sf), path)
    return readers.read_coview(spark, path, "S").select("skuX", "skuY", "ggXY")


@query(
    "SELECT doc_id AS doc, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n_tokens FROM documents",
    prelude=False,
)
def corpus_lines(spark, sf):
    corpus = readers.corpus_tokens(table(spark, sf, "documents"), "doc_id", "text")
    return corpus.select("doc", F.size("tokens").cast("long").alias("n_tokens"))


@query(r"""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS token FROM documents)
GROUP BY token""", prelude=False)
def corpus_file(spark, sf):
    """A corpus of one document per line, through its reader."""
    path = scratch_path(spark, "corpus")
    table(spark, sf, "documents").where("text IS NOT NULL").select(F.regexp_replace("text", r"[\r\n]+", " ")).write.text(path)
    spelled = terms.each_token(readers.read_corpus(spark, path), "doc")
    per_doc = spelled.groupBy(F.col("word").alias("token"), "doc").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


# --- text ------------------------------------------------------------------


def clean_sql(text: str) -> str:
    """The cleaning chain for DuckDB, whose expressions have no look-around."""
    sub = lambda e, p, r: f"regexp_replace({e}, '{p}', '{r}', 'g')"
    swap = lambda e, a, b: f"replace({e}, {a}, {b})"
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    e = sub(text, r"<[^>\n]*>", " ")
    for a, b in (("&quot;", '"'), ("&quot", '"'), ("&amp;", "and"), ("&amp", "and"), ("`", "'"), ("w/", "with "), ("|", " , "), ("ß", "ss")):
        e = swap(e, lit(a), lit(b))
    e = sub(f"strip_accents({e})", r"[^\x00-\x7F]", "")
    e = sub(e, r"[():?*;!\[\]_~{}^|\\]", " ")
    e = swap(sub(e, r"(\w)#", r"\1 number"), "'='", "' = '")
    e = sub(e, r"\d", "^")
    for mark, spaced in ((",", " , "), (".", " . "), ("-", " , ")):
        e = swap(swap(swap(e, lit(mark + "^"), "chr(1)"), lit(mark), lit(spaced)), "chr(1)", lit(mark + "^"))
    e = swap(swap(e, lit("^'"), lit("^ inches")), lit('^"'), lit("^ feet"))
    e = swap(swap(swap(e, lit("'"), "''"), lit('"'), "''"), "'$'", "' dollars '")
    return sub(f"lower({e})", r",([\s\x0b\x1c-\x1f]*,)+", ",")


def tokens_sql(text: str) -> str:
    e = clean_sql(text)
    for a, b in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")):
        e = rf"regexp_replace({e}, '\b({a})({b})\b', '\1 \2', 'g')"
    stop = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
    return rf"list_filter(regexp_extract_all({e}, '[#@%&<>,]|[^\s#@%&<>,]+'), lambda t: t NOT IN ({stop}))"


DOC_TOKENS = f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents), occ AS (SELECT doc_id, unnest(tokens) AS word FROM t)"


@query(f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents", prelude=False)
def clean_documents(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages", prelude=False)
def clean_pages(spark, sf):
    return texts(spark, sf, "pages").select("page_id", clean_text(F.col("html")).alias("cleaned"))


def _documents(spark, sf):
    return terms.with_title_tokens(texts(spark, sf, "documents"), title="text").select("doc_id", "tokens")


@query(
    f"{DOC_TOKENS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, tokens[i] AS token "
    "FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM t)",
    prelude=False,
)
def title_tokens(spark, sf):
    return terms.each_token(_documents(spark, sf), "doc_id", places=True).withColumnRenamed("word", "token")


@query(f'{DOC_TOKENS} SELECT word, count(*) AS "count" FROM occ GROUP BY word HAVING count(*) >= 5', prelude=False)
def vocab_min_count(spark, sf):
    return terms.token_counts(_documents(spark, sf), 5)


@query(f"{DOC_TOKENS} SELECT word, count(DISTINCT doc_id) AS df FROM occ GROUP BY word", prelude=False)
def term_df(spark, sf):
    return terms.document_frequency(_documents(spark, sf))


@query(f"{DOC_TOKENS} SELECT doc_id, word, count(*) AS tf FROM occ GROUP BY doc_id, word", prelude=False)
def term_tf(spark, sf):
    return terms.term_frequency(_documents(spark, sf), "doc_id")


TFIDF_SQL = """{tokens}, tf AS (SELECT doc_id, word, count(*) AS tf FROM occ GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
raw AS (SELECT doc_id, word, tf, df, tf * {idf} AS w
  FROM tf JOIN df USING (word), (SELECT count(*) AS n FROM documents) WHERE {keep})
SELECT doc_id, word, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


@query(TFIDF_SQL.format(tokens=DOC_TOKENS, idf="log2(n / df)", keep="df < n"), prelude=False)
def tfidf_terms(spark, sf):
    weights = terms.tfidf(_documents(spark, sf), "doc_id")
    return weights.withColumn("weight", rounded(F.col("weight")))


@query(TFIDF_SQL.format(tokens=DOC_TOKENS, idf="(ln((1 + n) / (1 + df)) + 1)", keep="df <= 0.9 * n"), prelude=False)
def tfidf_terms_smooth(spark, sf):
    weights = terms.tfidf(_documents(spark, sf), "doc_id", smooth=True, max_df=0.9)
    return weights.withColumn("weight", rounded(F.col("weight")))


# --- vectors ---------------------------------------------------------------


def _tokenised(spark, sf):
    products = terms.with_title_tokens(normalised(spark, sf))
    return terms.keep_vocabulary_tokens(products, fx.words(spark, sf))


@query("SELECT id, title FROM catalog WHERE id IN (SELECT id FROM title_words)")
def vocab_filter(spark, sf):
    return _tokenised(spark, sf).select("id", "title")


@query(ELEMENTS_SQL.format(key="id", vec="title_vec", source="title_vecs"))
def title_tfidf_vec(spark, sf):
    docs = materialise(_tokenised(spark, sf).select("id", "tokens"))
    return elements(titles.tfidf_title_vectors(docs, fx.words(spark, sf)), "id", "title_vec")


@query(ELEMENTS_SQL.format(key="id", vec="title_vec", source="title_vecs"))
def title_tfidf_vec_joined(spark, sf):
    docs = materialise(_tokenised(spark, sf).select("id", "tokens"))
    joined = titles.tfidf_title_vectors(docs, fx.words(spark, sf), max_broadcast_bytes=0)
    return elements(joined, "id", "title_vec")


@query(ELEMENTS_SQL.format(key="id", vec="title_vec", source="mean_vecs"))
def title_mean_vec(spark, sf):
    return elements(titles.mean_title_vectors(_tokenised(spark, sf), fx.words(spark, sf)), "id", "title_vec")


@query("""WITH bought AS (
  SELECT o_custkey AS id, 'w' || (l_partkey % (SELECT count(*) FROM embeddings)) AS word
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
words AS (SELECT 'w' || vec_id AS word, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
dims AS (SELECT unnest(range(1, (SELECT max(len(vec)) FROM words) + 1)) AS i),
sums AS (SELECT id, i, avg(vec[i]) AS s FROM bought JOIN words USING (word), dims GROUP BY id, i)
SELECT id, CAST(i - 1 AS INTEGER) AS dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) + 0.0 AS value
FROM sums""", prelude=False)
def mean_vec_all_words(spark, sf):
    """Mean vectors over a word table with every embedding."""
    docs, words = fx.part_words(spark, sf)
    return elements(titles.mean_title_vectors(docs, words), "id", "title_vec")


@query(ELEMENTS_SQL.format(key="id", vec="product_vec", source="product_vecs"))
def product_vec(spark, sf):
    return elements(titles.product_vectors(fx.catalog(spark, sf), fx.words(spark, sf)), "id", "product_vec")


@query(ELEMENTS_SQL.format(key="id", vec="image_vec", source="image_vecs"))
def image_unit_vec(spark, sf):
    images = fx.images(spark, sf).withColumn("image_vec", l2_normalize("prelogits"))
    return elements(images, "id", "image_vec")


TOP_PHRASES = "SELECT products AS value, count(*) AS \"count\" FROM catalog WHERE products IS NOT NULL GROUP BY products ORDER BY 2 DESC, 1 LIMIT 80"
#: Own examples: known words, a known one that is among the top products as well (and so occurs twice), a mix
#: with an unknown one, and unknown words.
EXTRA_PHRASES = ["red steel", "blue", "steel and lamp", "lantern", "oak chair"]


@query(TOP_PHRASES)
def top_products(spark, sf):
    return terms.top_values(fx.catalog(spark, sf), "products", 80)


def _phrases(spark, sf):
    top = terms.top_values(fx.catalog(spark, sf), "products", 80).select(F.col("value").alias("phrase"))
    return top.unionByName(spark.createDataFrame([(p,) for p in EXTRA_PHRASES], "phrase string"))


PHRASE_CTE = f"""
, phrases AS (SELECT phrase, row_number() OVER (ORDER BY phrase) AS n
  FROM (SELECT value AS phrase FROM ({TOP_PHRASES}) UNION ALL SELECT unnest({EXTRA_PHRASES!r}))),
phrase_words AS (SELECT phrase, n, unnest(regexp_split_to_array(phrase, ' and |\\s')) AS word FROM phrases),
known AS (SELECT phrase, n FROM phrase_words GROUP BY phrase, n
  HAVING bool_and(word IN (SELECT word FROM words))),
phrase_sum AS (SELECT phrase, n, i, avg(vec[i]) AS s FROM phrase_words JOIN known USING (phrase, n)
  JOIN words USING (word), dims GROUP BY phrase, n, i),
phrase_vecs AS (SELECT phrase, list_transform(list(s ORDER BY i), lambda x: x / sqrt(sum(s * s))) AS vec
  FROM phrase_sum GROUP BY phrase, n)
"""


@query(PHRASE_CTE + "SELECT phrase FROM known")
def phrase_all_in_vocab(spark, sf):
    return terms.phrases_in_vocabulary(_phrases(spark, sf), fx.words(spark, sf)).select("phrase")


@query(PHRASE_CTE + ELEMENTS_SQL.format(key="phrase", vec="vec", source="phrase_vecs"))
def phrase_vec(spark, sf):
    return elements(titles.phrase_vectors(_phrases(spark, sf), fx.words(spark, sf)), "phrase", "vec")


# --- distances on co-viewed pairs ------------------------------------------


FEATURES_CTE = """
, featured AS (SELECT c.*, primary_sku_id, title_vec, image_vec, product_vec
  FROM roles c JOIN title_vecs USING (id) LEFT JOIN image_vecs USING (id) LEFT JOIN product_vecs USING (id)),
pairs AS (SELECT "skuX", "skuY", a.title_vec AS ta, b.title_vec AS tb, a.image_vec AS ai, b.image_vec AS bi,
  a.product_vec AS ap, b.product_vec AS bp, a.brand AS ab, b.brand AS bb, a.price_hint AS i, b.price_hint AS j,
  a.products AS an, a."parentProducts" AS aparent, b.products AS bn, b."parentProducts" AS bparent
  FROM coview JOIN featured b ON b.sku_id = "skuX" JOIN featured a ON a.sku_id = "skuY")
"""
PRICE_SQL = "(CASE WHEN {j} < {i} THEN ({i} - {j}) / ({i} + {j}) WHEN {j} > 1.1 * {i} THEN ({j} - 1.1 * {i}) / ({i} + {j}) ELSE 0.0 END)"
PRODUCT_FALLBACK_FREE = "ap IS NOT NULL AND bp IS NOT NULL"


def blend_sql(w: Weights, a: str = "a.", b: str = "b.") -> str:
    price = PRICE_SQL.format(i=f"{a}price_hint", j=f"{b}price_hint")
    terms_ = [f"{w.title} * (1 - list_dot_product({a}title_vec, {b}title_vec)) * 0.5"]
    if w.image:
        terms_.append(f"{w.image} * (1 - list_dot_product({a}image_vec, {b}image_vec))")
    if w.product:
        terms_.append(f"{w.product} * (1 - list_dot_product({a}product_vec, {b}product_vec)) * 0.5")
    if w.brand:
        terms_.append(f"{w.brand} * (CASE WHEN {a}brand = {b}brand THEN 0 ELSE 1 END)")
    if w.price:
        terms_.append(f"{w.price} * {price}")
    return " + ".join(terms_)


def _pair_distance(spark, sf, weights: Weights, expression, *columns: str) -> DataFrame:
    """A distance between the two ends of every co-view row (candidate y, query x)."""
    model = Model(weights=weights, digits=DIGITS)
    words, images = materialise(fx.words(spark, sf), "words"), fx.images(spark, sf)
    products = select_products(normalised(spark, sf), model, words, images)
    pairs = fx.coview(spark, sf).select("skuX", "skuY")
    if set(columns) & {"title_vec", "product_vec"} and titles.fits(words):
        joined = _with_vectors_of_ends(pairs, products, words, columns, fx.dealer(spark, sf))
    else:
        featured = with_features(products, model, words) if set(columns) & {"title_vec", "image_vec", "product_vec"} else products
        joined = _with_ends(pairs, materialise(featured.select("sku_id", *columns), "featured"), columns, fx.dealer(spark, sf))
    value = expression(lambda c: F.col(f"Y.{c}"), lambda c: F.col(f"X.{c}"))
    return joined.select("skuX", "skuY", rounded(value).alias("distance"))


def _with_ends(pairs: DataFrame, featured: DataFrame, columns, deal) -> DataFrame:
    """``skuX, skuY, X, Y``: pairs whose ends are both there, with the columns of their ends."""
    end = lambda name: unbroadcast(featured).select(F.col("sku_id").alias(f"sku{name}"), F.struct(*columns).alias(name))
    if "image_vec" in columns:  # many products have no image: their pairs go before a vector is sent along
        pairs = pairs.join(unbroadcast(featured.select(F.col("sku_id").alias("skuY"))), "skuY", "left_semi")
    return deal(deal(pairs, "skuX").join(end("X"), "skuX"), "skuY").join(end("Y"), "skuY")


def _with_vectors_of_ends(pairs: DataFrame, products: DataFrame, words: DataFrame, columns, deal) -> DataFrame:
    """The same with the features of :func:`with_features`. Pairs are joined with the words
    of their ends; vectors, which are many times longer, are made after that."""
    made, known = {}, products.where("id IS NOT NULL")
    if "title_vec" in columns:
        made["title_vec"], known = titles.tfidf_words(products.select("id", "tokens"), words), known.withColumnRenamed("tokens", "title_vec")
    if "image_vec" in columns:
        known = known.withColumn("image_vec", l2_normalize("prelogits"))
    if "product_vec" in columns:
        made["product_vec"], known = words, known.withColumn("product_vec", product_words(F.col("products")))
    carried = list(dict.fromkeys(["id", *columns] if "product_vec" in columns else columns))
    joined = _with_ends(pairs, materialise(known.select("sku_id", *carried), "ends"), carried, deal)
    flat = joined.select("skuX", "skuY", *(F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in "XY" for c in carried))
    flat = titles.unit_vectors_in_place(flat, {f"{end}_{c}": table_ for end in "XY" for c, table_ in made.items()})
    if "product_vec" in columns:
        dim = titles.vector_length(words)
        unknown = lambda end: l2_normalize(hashed_vector(F.col(f"{end}_id"), dim))
        flat = flat.withColumns({f"{end}_product_vec": F.coalesce(f"{end}_product_vec", unknown(end)) for end in "XY"})
    return flat.select("skuX", "skuY", *(F.struct(*(F.col(f"{end}_{c}").alias(c) for c in columns)).alias(end) for end in "XY"))


TITLE_ONLY = Weights(title=1.0, image=0.0)
WITH_IMAGE = Weights(title=1.0, image=1.0)
WITH_PRODUCT = Weights(title=1.0, image=0.0, product=1.0)


@query(FEATURES_CTE + 'SELECT "skuX", "skuY", round((1 - list_dot_product(ta, tb)) * 0.5, 6) + 0.0 AS distance FROM pairs')
def dist_title(spark, sf):
    f = lambda a, b: d.title_distance(a("title_vec"), b("title_vec"))
    return _pair_distance(spark, sf, TITLE_ONLY, f, "title_vec")


@query(FEATURES_CTE + 'SELECT "skuX", "skuY", round(1 - list_dot_product(ai, bi), 6) + 0.0 AS distance FROM pairs WHERE ai IS NOT NULL AND bi IS NOT NULL')
def dist_image(spark, sf):
    f = lambda a, b: d.image_distance(a("image_vec"), b("image_vec"))
    return _pair_distance(spark, sf, WITH_IMAGE, f, "image_vec")


@query(FEATURES_CTE + 'SELECT "skuX", "skuY", round((1 - list_dot_product(ap, bp)) * 0.5, 6) + 0.0 AS distance FROM pairs')
def dist_product(spark, sf):
    f = lambda a, b: d.product_distance(a("product_vec"), b("product_vec"))
    return _pair_distance(spark, sf, WITH_PRODUCT, f, "product_vec")


@query(FEATURES_CTE + 'SELECT "skuX", "skuY", (CASE WHEN ab = bb THEN 0.0 ELSE 1.0 END)::DOUBLE AS distance FROM pairs')
def dist_brand(spark, sf):
    return _pair_distance(spark, sf, TITLE_ONLY, lambda a, b: d.brand_distance(a("brand"), b("brand")), "brand")


@query(FEATURES_CTE + f'SELECT "skuX", "skuY", round({PRICE_SQL.format(i="i", j="j")}, 6) + 0.0 AS distance FROM pairs')
def dist_price(spark, sf):
    f = lambda a, b: d.price_distance(a("price_hint"), b("price_hint"))
    return _pair_distance(spark, sf, TITLE_ONLY, f, "price_hint")


@query("""
, image_words AS (SELECT id, word FROM title_words WHERE id IN (SELECT id FROM images)),
image_df AS (SELECT word, count(DISTINCT id) AS df FROM image_words GROUP BY word),
image_sum AS (SELECT id, i, sum(vec[i] * ln((SELECT count(DISTINCT id) FROM image_words) / df)) AS s
  FROM image_words JOIN words USING (word) JOIN image_df USING (word), dims GROUP BY id, i),
image_titles AS (SELECT id, list_transform(list(s ORDER BY i), lambda x: x / sqrt(sum(s * s))) AS title_vec
  FROM image_sum GROUP BY id),
featured AS (SELECT c.*, title_vec, image_vec, product_vec FROM catalog c JOIN image_titles USING (id)
  JOIN image_vecs USING (id) JOIN product_vecs USING (id))
SELECT "skuX", "skuY", round(""" + blend_sql(FULL) + """, 6) + 0.0 AS distance
FROM coview JOIN featured b ON b.sku_id = "skuX" JOIN featured a ON a.sku_id = "skuY" """)
def dist_combo(spark, sf):
    return _pair_distance(spark, sf, FULL, lambda a, b: d.blended_distance(a, b, FULL), *FULL.columns())


@query(FEATURES_CTE + """SELECT "skuX", "skuY", (CASE WHEN an IS NULL OR bn IS NULL THEN 0.8 WHEN an = bn THEN 0.0
WHEN an = bparent OR bn = aparent THEN 0.1
WHEN contains(bn, aparent) OR contains(an, bparent) THEN 0.3
WHEN contains(bn, an) OR contains(an, bn) THEN 0.3 ELSE 1.0 END)::DOUBLE AS distance FROM pairs""")
def rule_ladder_distance(spark, sf):
    f = lambda a, b: d.product_rule_distance(a("products"), a("parentProducts"), b("products"), b("parentProducts"))
    return _pair_distance(spark, sf, TITLE_ONLY, f, "products", "parentProducts")


# --- neighbours ------------------------------------------------------------


IMAGE_FEATURES = """
, chosen AS (SELECT * FROM catalog WHERE id IN (SELECT id FROM images) AND id IN (SELECT id FROM title_words)),
chosen_words AS (SELECT id, word FROM title_words WHERE id IN (SELECT id FROM chosen)),
"""
ALL_FEATURES = """
, chosen AS (SELECT * FROM catalog WHERE id IN (SELECT id FROM title_words)),
chosen_words AS (SELECT id, word FROM title_words),
"""
CHOSEN_TITLES = """
chosen_df AS (SELECT word, count(DISTINCT id) AS df FROM chosen_words GROUP BY word),
chosen_sum AS (SELECT id, i, sum(vec[i] * ln((SELECT count(*) FROM chosen) / df)) AS s
  FROM chosen_words JOIN words USING (word) JOIN chosen_df USING (word), dims GROUP BY id, i),
chosen_vec AS (SELECT id, list_transform(list(s ORDER BY i), lambda x: x / sqrt(sum(s * s))) AS title_vec
  FROM chosen_sum GROUP BY id),
featured AS (SELECT c.*, title_vec, image_vec, product_vec FROM chosen c JOIN chosen_vec USING (id)
  LEFT JOIN image_vecs USING (id) LEFT JOIN product_vecs USING (id))
"""


def topk_sql(features: str, weights: Weights, k: int, method: str = "tfidf_word2vec") -> str:
    return features + f"""
, scored AS (SELECT b.id AS x, a.id AS y, a.group_id, a.sku_id AS pos, round(1 - ({blend_sql(weights)}), 6) AS score
  FROM featured b JOIN featured a ON a.category_id = b.category_id AND a.id <> b.id),
units AS (SELECT *, row_number() OVER (PARTITION BY x, coalesce(group_id, '#' || y) ORDER BY score DESC, pos) AS u FROM scored),
top AS (SELECT x, y, score, row_number() OVER (PARTITION BY x ORDER BY score DESC, y DESC) AS r FROM units WHERE u = 1)
SELECT x AS "idX", y AS "idY", score, '{method}' AS method FROM top WHERE r <= {k}
UNION ALL SELECT min(id), NULL, NULL, '{method}' FROM featured GROUP BY category_id HAVING count(*) = 1"""


def _recommend(spark, sf, weights: Weights, method: str = "tfidf_word2vec", **options) -> DataFrame:
    found, _ = recommend(
        fx.catalog(spark, sf), Model(weights=weights, method=method, digits=DIGITS),
        words=fx.words(spark, sf), images=fx.images(spark, sf), **options,
    )
    return found


@query(topk_sql(IMAGE_FEATURES + CHOSEN_TITLES, DEFAULT, 48))
def topk_recommend(spark, sf):
    return _recommend(spark, sf, DEFAULT)


@query(topk_sql(ALL_FEATURES + CHOSEN_TITLES, BLEND, 48))
def topk_price_brand(spark, sf):
    return _recommend(spark, sf, BLEND)


@query(topk_sql(IMAGE_FEATURES + CHOSEN_TITLES, FULL, 10))
def topk_all_components(spark, sf):
    return _recommend(spark, sf, FULL, k=10)


@query(topk_sql(ALL_FEATURES + CHOSEN_TITLES, BLEND, 48))
def topk_many_tiles(spark, sf):
    """The same result when categories are cut into many small tiles."""
    return _recommend(spark, sf, BLEND, tile_rows=max(64, table(spark, sf, "part").count() // 30))


@query(topk_sql(
    ", featured AS (SELECT c.*, title_vec FROM catalog c JOIN mean_vecs USING (id))", TITLE_ONLY, 48, "mean_word2vec"
))
def topk_titles_only(spark, sf):
    """Few distinct titles: almost every comparison is a tie between copies."""
    return _recommend(spark, sf, TITLE_ONLY, method="mean_word2vec")


@query(topk_sql(
    ", featured AS (SELECT c.*, title_vec FROM catalog c JOIN mean_vecs USING (id))", TITLE_ONLY, 48, "mean_word2vec"
))
def topk_ties_many_tiles(spark, sf):
    """Ties between copies that lie in different tiles."""
    rows = max(64, table(spark, sf, "part").count() // 30)
    return _recommend(spark, sf, TITLE_ONLY, method="mean_word2vec", tile_rows=rows)


GAP_FEATURES = """
, chosen AS (SELECT * REPLACE (
    CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN brand END AS brand,
    CASE WHEN CAST(id AS BIGINT) % 97 = 1 THEN 'only-' || id
         WHEN CAST(id AS BIGINT) % 41 <> 0 THEN category_id END AS category_id)
  FROM catalog WHERE CAST(id AS BIGINT) % 37 <> 0 AND id IN (SELECT id FROM title_words)),
chosen_words AS (SELECT id, word FROM title_words WHERE id IN (SELECT id FROM chosen)),
"""
#: The group without a category is no category: its products have no neighbours and no row of their own.
GAP_PAIRS = topk_sql(GAP_FEATURES + CHOSEN_TITLES, BLEND, 48).replace("HAVING count(*) = 1", "HAVING count(*) = 1 AND category_id IS NOT NULL")


def _gap_pairs(spark, sf):
    return recommend(fx.catalog_with_gaps(spark, sf), Model(weights=BLEND, digits=DIGITS), words=fx.words(spark, sf))[0]


@query(GAP_PAIRS)
def topk_with_gaps(spark, sf):
    """Missing titles, brands and categories, and categories of one product."""
    return _gap_pairs(spark, sf)


@query(GAP_PAIRS.replace('SELECT x AS "idX", y AS "idY", score,', 'SELECT x AS "idX", y AS "idY", score, true AS scored,')
       .replace("SELECT min(id), NULL, NULL,", "SELECT min(id), 'N/A', NULL, false,"))
def recommendation_file(spark, sf):
    """Pairs as JSON lines, read back; products without candidates show ``N/A``."""
    path = scratch_path(spark, "pairs")
    sinks.write_recommendations(_gap_pairs(spark, sf), path)
    fields = {name: F.get_json_object("value", f"$.{name}") for name in ("idX", "idY", "score", "method")}
    scored = fields["score"] != sinks.NOT_AVAILABLE
    return spark.read.text(path).select(
        fields["idX"].alias("idX"), fields["idY"].alias("idY"), fields["method"].alias("method"),
        F.when(scored, fields["score"]).cast("double").alias("score"), scored.alias("scored"),
    )


# --- evaluation ------------------------------------------------------------


@query("SELECT x, y, score FROM best")
def coview_best(spark, sf):
    roles = cat.with_roles(cat.drop_singleton_groups(fx.catalog(spark, sf)))
    return cv.best_coview(readers.coview_pairs(fx.coview(spark, sf), ""), roles)


@query("SELECT x, y, round(w_y, 9) AS w_y FROM weighted")
def coview_weights(spark, sf):
    return cv.coview_weights(coview_best(spark, sf)).withColumn("w_y", rounded(F.col("w_y"), 9))


@query("""SELECT x, y, round(pow(0.95, row_number() OVER (PARTITION BY x ORDER BY substr(y, 2, 1) DESC, y) - 1), 9) AS w_y
FROM best""")
def coview_weights_by_id(spark, sf):
    weighted = cv.coview_weights(coview_best(spark, sf), rank_by="id_char2")
    return weighted.withColumn("w_y", rounded(F.col("w_y"), 9))


EVALUATION_SQL = """
, dist AS (SELECT b.sku_id AS x, a.sku_id AS y, round({blend}, 6) AS dist
  FROM featured b JOIN featured a ON a.category_id = b.category_id {self}
  JOIN roles r ON r.sku_id = a.sku_id AND r.sku_id = r.primary_sku_id
  WHERE b.sku_id IN (SELECT x FROM weighted)),
ranked AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY dist, y) - 1 AS rank0 FROM dist),
hits AS (SELECT x, y, rank0, w_y, pow(0.95, rank0) AS s_y FROM ranked JOIN weighted USING (x, y)),
per_query AS (SELECT w.x, coalesce(s, 0.0) AS weight_sum, coalesce(f, 0.0) AS full_sum
  FROM (SELECT DISTINCT x FROM weighted) w
  LEFT JOIN (SELECT x, sum(w_y * s_y) AS s, sum(w_y * w_y) AS f FROM hits WHERE s_y > 0 GROUP BY x) h ON h.x = w.x)
"""


def evaluation_sql(weights: Weights, select: str, self: str = "") -> str:
    return ALL_FEATURES + CHOSEN_TITLES + EVALUATION_SQL.format(blend=blend_sql(weights), self=self) + select


def _evaluate(spark, sf, weights: Weights, **options) -> DataFrame:
    return evaluate_per_query(
        fx.catalog(spark, sf), readers.coview_pairs(fx.coview(spark, sf), ""),
        Model(weights=weights, digits=DIGITS), words=fx.words(spark, sf), images=fx.images(spark, sf), **options,
    )


@query(evaluation_sql(BLEND, "SELECT x, y, CAST(rank0 AS BIGINT) AS rank0 FROM hits"))
def candidate_rank(spark, sf):
    model = Model(weights=BLEND, digits=DIGITS)
    words = fx.words(spark, sf)
    featured = materialise(cat.with_roles(with_features(select_products(normalised(spark, sf), model, words), model, words)))
    weighted = cv.coview_weights(coview_best(spark, sf))
    return cv.candidate_ranks(featured, weighted, BLEND, DIGITS).select("x", "y", "rank0")


PER_QUERY = "SELECT x, round(weight_sum, 6) AS weight_sum, round(full_sum, 6) AS full_sum FROM per_query"


@query(evaluation_sql(BLEND, PER_QUERY))
def coview_eval_per_query(spark, sf):
    sums = _evaluate(spark, sf, BLEND)
    return sums.select("x", rounded(F.col("weight_sum")).alias("weight_sum"), rounded(F.col("full_sum")).alias("full_sum"))


@query(evaluation_sql(BLEND, PER_QUERY, "AND a.id <> b.id"))
def coview_eval_without_self(spark, sf):
    sums = _evaluate(spark, sf, BLEND, exclude_self=True)
    return sums.select("x", rounded(F.col("weight_sum")).alias("weight_sum"), rounded(F.col("full_sum")).alias("full_sum"))


@query(evaluation_sql(BLEND, "SELECT round(sum(weight_sum) / sum(full_sum), 6) AS ratio FROM per_query"))
def coview_ratio(spark, sf):
    return cv.coview_ratio(_evaluate(spark, sf, BLEND)).select(rounded(F.col("ratio")).alias("ratio"))


# --- models (no SQL form: rows only) ---------------------------------------


def _corpus(spark, sf):
    return _documents(spark, sf).withColumnRenamed("doc_id", "doc")


def _stems(spark, sf):
    return materialise(titles.stemmed_tokens(fx.catalog(spark, sf), stop_words=Model().stems_left_out()), "stems")


@query()
def lsa_vectors(spark, sf):
    return elements(lsa.lsa_title_vectors(_stems(spark, sf), rank=8), "id", "title_vec")


#: With as many directions as there are terms nothing is lost: products of vectors are those of the tf-idf rows.
#: Every word of the part names has a stem of its own.
@query("""
, spelled AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(string_split(title, ' ')) AS word FROM catalog) GROUP BY 1, 2),
counted AS (SELECT word, count(*) AS df FROM spelled GROUP BY word),
kept AS (SELECT id, word, tf * (ln((1 + (SELECT count(*) FROM catalog)) / (1 + df)) + 1) AS w
  FROM spelled JOIN counted USING (word) WHERE df <= 0.9 * (SELECT count(*) FROM catalog)),
unit AS (SELECT id, word, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM kept),
asked AS (SELECT * FROM unit WHERE CAST(id AS BIGINT) % 100 = 0)
SELECT a.id AS x, b.id AS y, round(coalesce(sum(c.w * d.w), 0), 6) + 0.0 AS product
FROM (SELECT DISTINCT id FROM asked) a CROSS JOIN (SELECT DISTINCT id FROM unit) b
LEFT JOIN (asked c JOIN unit d USING (word)) ON c.id = a.id AND d.id = b.id GROUP BY 1, 2""")
def lsa_gram(spark, sf):
    """Products of the vectors of all titles with those whose id is divisible by 100."""
    vectors = materialise(lsa.lsa_title_vectors(_stems(spark, sf), rank=16), "lsa-titles")
    asked = vectors.where(F.col("id").cast("long") % 100 == 0).select(F.col("id").alias("x"), F.col("title_vec").alias("v"))
    # one query in a hundred, against all
    pairs = vectors.select(F.col("id").alias("y"), "title_vec").join(asked, F.lit(True))
    return pairs.select("x", "y", rounded(dot(F.col("v"), F.col("title_vec"), 16)).alias("product"))


@query(f"{DOC_TOKENS}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT word, count(DISTINCT doc_id) AS df FROM occ GROUP BY word) "
       "SELECT doc_id, 300 AS dims, CASE WHEN bool_or(df <= 0.9 * n) THEN 1.0 ELSE 0.0 END + 0.0 AS norm, "
       "CAST(count(DISTINCT word) > 0 AS BOOLEAN) AS finite FROM occ JOIN df USING (word), n GROUP BY doc_id", prelude=False)
def lsa_documents(spark, sf):
    """Rank 300 on all documents: every document with a term has a unit vector of that length."""
    docs = materialise(_documents(spark, sf), "lsa-input")
    vectors = lsa.lsa_title_vectors(docs.where(F.size("tokens") > 0), rank=300, key="doc_id")
    norm = F.sqrt(dot(F.col("title_vec"), F.col("title_vec")))
    finite = F.forall("title_vec", lambda x: ~F.isnan(x) & (F.abs(x) <= 1.000001))
    return vectors.select("doc_id", F.size("title_vec").alias("dims"), rounded(norm).alias("norm"), finite.alias("finite"))


@query()
def lsa_explained_variance(spark, sf):
    return lsa.explained_variance(_stems(spark, sf), [2, 4, 8, 16])


@query()
def topk_lsa(spark, sf):
    found, _ = recommend(fx.catalog(spark, sf), Model(weights=BLEND, method="lsa", lsa_rank=8, digits=DIGITS))
    return found


@query()
def word2vec_train(spark, sf):
    return elements(embeddings.train_word_vectors(materialise(_corpus(spark, sf)), dim=16, epochs=2), "word", "vec")


def _checked(vectors: DataFrame, key: str, column: str = "vec") -> DataFrame:
    """What must hold of vectors whatever was learned: one per key, their length, no missing numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e6))
    return vectors.select(key, F.size(column).alias("dims"), finite.alias("finite"))


FREQUENT_WORDS = f"{DOC_TOKENS} SELECT word, 16 AS dims, true AS finite FROM occ GROUP BY word HAVING count(*) >= 5"


@query(FREQUENT_WORDS, prelude=False)
def word2vec_words(spark, sf):
    return _checked(embeddings.train_word_vectors(materialise(_corpus(spark, sf)), dim=16, epochs=1), "word")


@query(FREQUENT_WORDS, prelude=False)
def ngram_words(spark, sf):
    """Words learned next to word n-grams of up to three words."""
    return _checked(embeddings.train_word_vectors(materialise(_corpus(spark, sf)), dim=16, window=5, epochs=1, ngrams=3), "word")


@query("SELECT doc_id AS doc, true AS same FROM documents WHERE doc_id % 100 = 0", prelude=False)
def infer_alone(spark, sf):
    """Vectors inferred for one document in a hundred by themselves are those inferred with all others."""
    corpus = materialise(_corpus(spark, sf))
    _, words = embeddings.train_document_vectors(corpus, dim=16, epochs=1)
    every = embeddings.infer_document_vectors(corpus, words, epochs=2)
    alone = embeddings.infer_document_vectors(corpus.where("doc % 100 = 0"), words, epochs=2)
    return every.join(alone.withColumnRenamed("vec", "own"), "doc").select("doc", (F.col("vec") == F.col("own")).alias("same"))


@query()
def pvdm_train(spark, sf):
    docs, _ = embeddings.train_document_vectors(materialise(_corpus(spark, sf)), dim=16, epochs=2)
    return elements(docs, "doc", "vec")


@query()
def topk_document_vectors(spark, sf):
    """Method ``dm``: title vectors inferred from a model of the titles."""
    products = terms.with_title_tokens(fx.catalog(spark, sf)).select(F.col("id").alias("doc"), "tokens")
    corpus = materialise(embeddings.tagged_corpus(t=products))
    _, words = embeddings.train_document_vectors(corpus, dim=16, epochs=2)
    vectors = embeddings.infer_document_vectors(products, words).withColumnRenamed("doc", "id")
    return _recommend(spark, sf, BLEND, method="dm", document_vectors=materialise(vectors))


@query()
def sif_vectors(spark, sf):
    docs = materialise(_tokenised(spark, sf).select("id", "tokens"))
    counts = terms.token_counts(docs)
    return elements(quality.weighted_document_vectors(docs, fx.words(spark, sf), counts), "id", "vec")


@query("""
, word_counts AS (SELECT word, count(*) AS n FROM title_words GROUP BY word),
sif AS (SELECT id, i, avg(vec[i] * 0.001 / (0.001 + n / (SELECT count(*) FROM title_words))) AS s
  FROM title_words JOIN words USING (word) JOIN word_counts USING (word), dims GROUP BY id, i)
SELECT id, CAST(i - 1 AS INTEGER) AS dim, round(s, 6) + 0.0 AS value FROM sif""")
def sif_vectors_uncentred(spark, sf):
    docs = materialise(_tokenised(spark, sf).select("id", "tokens"))
    counts = terms.token_counts(docs)
    return elements(
        quality.weighted_document_vectors(docs, fx.words(spark, sf), counts, remove_component=False), "id", "vec"
    )


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query()
def cluster_quality(spark, sf):
    return quality.cluster_quality(_vectors(spark, sf), "embedding", "label", 10)


@query("""WITH t AS (SELECT p_type AS l, p_brand AS r, count(*) AS n FROM part GROUP BY 1, 2),
m AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS v,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY l)) AS a,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY r)) AS b,
  (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS w)
SELECT round((v - a * b / w) / ((a + b) / 2 - a * b / w), 9) AS adjusted_rand FROM m""", prelude=False)
def adjusted_rand(spark, sf):
    table_ = quality.contingency(table(spark, sf, "part"), "p_type", "p_brand")
    return quality.adjusted_rand(table_).select(rounded(F.col("adjusted_rand"), 9).alias("adjusted_rand"))


@query()
def classifier_quality(spark, sf):
    return quality.classifier_quality(_vectors(spark, sf), "embedding", "label", regParam=0.1)


@query()
def classifier_tuning(spark, sf):
    return quality.tune_classifier(
        _vectors(spark, sf), "embedding", "label", [{"regParam": 0.01}, {"regParam": 0.1}], folds=3
    )
