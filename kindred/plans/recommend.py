"""Recommendation job: catalog, word vectors and image vectors in, pairs out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.distance import Weights
from kindred.functions.vectors import l2_normalize
from kindred.functions.wordlists import ENGLISH_STOP_WORDS
from kindred.operators.catalog import join_images, normalise_catalog, require_unique
from kindred.operators.lsa import lsa_title_vectors
from kindred.operators.neighbours import top_neighbours
from kindred.operators.terms import keep_vocabulary_tokens, with_title_tokens
from kindred.operators.titles import (
    mean_title_vectors,
    product_vectors,
    stemmed_tokens,
    tfidf_title_vectors,
)
from kindred.session import materialise, unbroadcast

WORD_METHODS = ("tfidf_word2vec", "mean_word2vec")
METHODS = (*WORD_METHODS, "lsa", "dm")


@dataclass(frozen=True)
class Model:
    """How products are compared.

    ``method`` is one of :data:`METHODS`; the word methods need a ``words`` table,
    ``dm`` needs ``document_vectors`` (``id, vec``) from
    :func:`kindred.operators.embeddings.infer_document_vectors`. ``lsa`` compares
    stems and has a stop list of its own, ``lsa_stop_words`` (None: Spark's English list).
    """

    weights: Weights = field(default_factory=Weights)
    method: str = "tfidf_word2vec"
    lsa_rank: int = 300
    stop_words: Iterable[str] = tuple(ENGLISH_STOP_WORDS)
    lsa_stop_words: Iterable[str] | None = None
    null_safe_brand: bool = False
    digits: int = 9

    def stems_left_out(self) -> list[str]:
        """The stop list of ``lsa``, which is held against stems."""
        if self.lsa_stop_words is not None:
            return list(self.lsa_stop_words)
        # cleaning has removed the apostrophes of the tokens
        return [word.replace("'", "") for word in StopWordsRemover.loadDefaultStopWords("english")]

    @classmethod
    def of(cls, weights: Weights | Mapping[str, float] | None = None, **options) -> "Model":
        return cls(Weights.of(weights), **options)


def select_products(
    catalog: DataFrame, model: Model, words: DataFrame | None = None, images: DataFrame | None = None
) -> DataFrame:
    """Products that take part: with a known title word (word methods) and with
    an image (unless images weigh nothing). Written out once."""
    if model.method not in METHODS:
        raise ValueError(f"unknown method {model.method!r}, expected one of {METHODS}")
    products = catalog
    if model.method in WORD_METHODS:
        _need(words, "words", model.method)
        products = keep_vocabulary_tokens(with_title_tokens(products, model.stop_words), words)
    if model.weights.image:
        _need(images, "images", "a non-zero image weight")
        products = join_images(products, images)
    return materialise(products, "products")


def with_features(
    products: DataFrame,
    model: Model,
    words: DataFrame | None = None,
    document_vectors: DataFrame | None = None,
) -> DataFrame:
    """Add the vectors the weights ask for. A product with several images stays
    as many rows: vectors are joined back once per ``id``."""
    if model.method == "tfidf_word2vec":
        titles = tfidf_title_vectors(products.select("id", "tokens"), words)
    elif model.method == "mean_word2vec":
        titles = mean_title_vectors(products.select("id", "tokens"), words)
    elif model.method == "lsa":
        titles = lsa_title_vectors(stemmed_tokens(products, stop_words=model.stems_left_out()), model.lsa_rank)
    else:
        _need(document_vectors, "document_vectors", model.method)
        titles = document_vectors.select("id", l2_normalize("vec").alias("title_vec"))
    featured = products.join(unbroadcast(titles.dropDuplicates(["id"])), "id")
    if model.weights.image:
        featured = featured.withColumn("image_vec", l2_normalize("prelogits")).drop("prelogits")
    if model.weights.product:
        _need(words, "words", "a non-zero product weight")
        vectors = product_vectors(products.select("id", "products").dropDuplicates(["id"]), words)
        featured = featured.join(unbroadcast(vectors), "id")
    return featured


def _need(table: DataFrame | None, name: str, why: str) -> None:
    if table is None:
        raise ValueError(f"{why} needs the {name} table")


def recommend(
    raw_catalog: DataFrame,
    model: Model = Model(),
    k: int = 48,
    words: DataFrame | None = None,
    images: DataFrame | None = None,
    document_vectors: DataFrame | None = None,
    tile_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(recommendations ``idX, idY, score, method``; products that took part)."""
    catalog = require_unique(materialise(normalise_catalog(raw_catalog), "catalog"), "id")
    products = select_products(catalog, model, words, images)
    featured = with_features(products, model, words, document_vectors)
    found = top_neighbours(
        featured, model.weights, k, model.method, model.digits,
        null_safe_brand=model.null_safe_brand, tile_rows=tile_rows,
    )
    return found, products
