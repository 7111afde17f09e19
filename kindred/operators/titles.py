"""Unit vectors for titles, products and phrases from word vectors; stemmed titles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.stemming import with_stems
from kindred.functions.text import clean_text, product_words, word_tokens
from kindred.functions.vectors import hashed_vector, l2_normalize, scale
from kindred.operators.terms import BROADCAST_WORDS, document_frequency, keep_vocabulary_tokens, phrases_in_vocabulary
from kindred.session import materialise, unbroadcast

BROADCAST_BYTES = 256 << 20


def vector_length(vectors: DataFrame, column: str = "vec") -> int:
    """Length of the (equally long) vectors of a table, from one row."""
    first = vectors.select(F.size(column)).first()
    if first is None:
        raise ValueError("the vector table is empty")
    return first[0]


def _sums(matrix: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, cut: int = 65536) -> np.ndarray:
    """Sums of the ``matrix`` rows of documents that follow each other in ``rows``: many short documents
    at a time, and a long one in slices, so that memory stays bounded."""
    out = np.empty((len(starts), matrix.shape[1]))
    ends, i = starts + counts, 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + cut, side="right")))
        if counts[i] <= cut:
            out[i:j] = np.add.reduceat(matrix[rows[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0)
        else:
            out[i] = sum(matrix[rows[at : min(at + cut, ends[i])]].sum(axis=0) for at in range(starts[i], ends[i], cut))
        i = j
    return out


def _summing_batches(shared, dim: int, every: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        index, matrix = shared.value
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rows = np.asarray(index.get_indexer(lists.flatten().to_pandas()))
            doc, rows = doc[rows >= 0], rows[rows >= 0]
            found, starts, counts = np.unique(doc, return_index=True, return_counts=True)
            if not len(found) and not every:
                continue
            out = _sums(matrix, rows, starts, counts)
            if every:
                n = np.zeros(len(sizes), np.int64)
                n[found] = counts
                ends = np.r_[0, np.cumsum(n > 0) * dim].astype(np.int32)
                totals = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), totals, pa.array(n)], names=["key", "total", "n"])
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(found)),
                    pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), out.ravel()),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["key", "total", "n"],
            )

    return run


def sum_word_vectors(
    docs: DataFrame, words: DataFrame, key: str = "id", max_broadcast_bytes: int = BROADCAST_BYTES, every: bool = False
) -> DataFrame:
    """``key, total, n``: sum and number of the vectors of a document's ``tokens``.

    Repeated tokens count again; documents without a known token are left out, or with
    ``every`` (for word tables that fit) stay with a null ``total``.
    A word table that is measured to fit ``max_broadcast_bytes`` is sent to every
    executor and documents never move. A larger one is joined by word. Of a word
    listed several times the smallest vector counts; rows that repeat a ``key``
    stay apart.
    """
    words = words.groupBy("word").agg(F.min("vec").alias("vec"))
    n_words, dim = words.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n_words:
        raise ValueError("the word table is empty")
    if n_words * dim * 8 <= max_broadcast_bytes:
        table = words.select("word", "vec").toArrow()
        matrix = table.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        shared = docs.sparkSession.sparkContext.broadcast((pd.Index(table.column("word").to_pandas()), matrix))
        schema = T.StructType(
            [
                T.StructField("key", docs.schema[key].dataType),
                T.StructField("total", T.ArrayType(T.DoubleType())),
                T.StructField("n", T.LongType()),
            ]
        )
        return docs.select(key, "tokens").mapInArrow(_summing_batches(shared, dim, every), schema).withColumnRenamed("key", key)
    if every:
        raise ValueError("documents without a known word are kept for word tables that fit only")
    spelled = docs.withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", F.posexplode("tokens").alias("pos", "word"))
    total = F.aggregate(
        F.array_sort(F.collect_list(F.struct("pos", "vec"))),
        F.array_repeat(F.lit(0.0), dim),
        lambda acc, x: F.zip_with(acc, x["vec"], lambda a, b: a + b),
    )
    return spelled.join(words, "word").groupBy(key, "_row").agg(total.alias("total"), F.count(F.lit(1)).alias("n")).drop("_row")


def mean_vectors(docs: DataFrame, words: DataFrame, key: str = "id", **options) -> DataFrame:
    """``key, vec``: plain mean of the word vectors of each document."""
    sums = sum_word_vectors(docs, words, key, **options)
    return sums.select(key, scale(F.col("total"), 1 / F.col("n")).alias("vec"))


def mean_title_vectors(docs: DataFrame, words: DataFrame, key: str = "id", **options) -> DataFrame:
    """``key, title_vec``: unit vector of the mean word vector."""
    sums = sum_word_vectors(docs, words, key, **options)
    return sums.select(key, l2_normalize("total").alias("title_vec"))


def tfidf_title_vectors(docs: DataFrame, words: DataFrame, key: str = "id", **options) -> DataFrame:
    """``key, title_vec``: unit vector of the tf-idf weighted word vectors.

    Every per-document factor and the base of the logarithm cancel in the unit
    length, so each occurrence of a word adds ``ln(N / df)`` times its vector.
    ``docs`` must hold vocabulary tokens only, all documents with at least one.
    A document whose words occur everywhere gets a zero vector.
    """
    sums = sum_word_vectors(docs, tfidf_words(docs, words), key, **options)
    return sums.select(key, l2_normalize("total").alias("title_vec"))


def tfidf_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``word, vec``: the words of ``docs``, their vectors times ``ln(N / df)``."""
    total = docs.select(F.count(F.lit(1)).alias("n")).scalar()
    return materialise(
        words.join(document_frequency(docs), "word").select("word", "vec", F.log(total / F.col("df")).alias("idf")),
        "weighted-words",
    ).select("word", scale(F.col("vec"), F.col("idf")).alias("vec"))


def fits(words: DataFrame, max_broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a word table can be sent to every executor."""
    n_words = words.agg(F.count_distinct("word")).first()[0]
    return 0 < n_words <= BROADCAST_WORDS and n_words * vector_length(words) * 8 <= max_broadcast_bytes


def product_vectors(
    products: DataFrame, words: DataFrame, key: str = "id", max_broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``key, product_vec``: unit vector of the mean vector of the product words.

    A missing or unknown product gets a repeatable pseudo-random vector. Where the
    word table fits, products are joined with their known words, and vectors, which
    are many times longer, are made after that.
    """
    dim = vector_length(words)
    spelled = products.select(key, product_words(F.col("products")).alias("tokens")).where("tokens IS NOT NULL")
    if fits(words, max_broadcast_bytes):
        known = keep_vocabulary_tokens(spelled, words, key)
        rows = products.select(key).join(unbroadcast(known), key, "left")
        sums = sum_word_vectors(rows, words, key, max_broadcast_bytes, every=True)
        vec = F.when(F.col("n") > 0, scale(F.col("total"), 1 / F.nullif("n", F.lit(0))))
        found = sums.select(key, F.coalesce(vec, hashed_vector(F.col(key), dim)).alias("vec"))
        return found.select(key, l2_normalize("vec").alias("product_vec"))
    known = mean_vectors(spelled, words, key, max_broadcast_bytes=max_broadcast_bytes)
    vec = F.coalesce("vec", hashed_vector(F.col(key), dim))
    return products.select(key).join(unbroadcast(known), key, "left").select(key, l2_normalize(vec).alias("product_vec"))


def _shared_words(words: DataFrame):
    """A word table that fits, on every executor: its words and the matrix of their vectors."""
    table = words.groupBy("word").agg(F.min("vec").alias("vec")).toArrow()
    matrix = table.column("vec").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return words.sparkSession.sparkContext.broadcast((pd.Index(table.column("word").to_pandas()), matrix))


def unit_vectors_in_place(rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``rows`` with lists of words replaced by the unit vectors of the sums of their words' vectors,
    null without a known word. ``tables`` has the word table, which must fit, of each such column."""
    by_table = {id(words): _shared_words(words) for words in tables.values()}
    shared = {name: by_table[id(words)] for name, words in tables.items()}
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(f.name, vector if f.name in tables else f.dataType) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for name, words in shared.items():
                index, matrix = words.value
                sizes = np.asarray(columns[name].value_lengths().fill_null(0))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                at = np.asarray(index.get_indexer(columns[name].flatten().to_pandas()))
                counts = np.bincount(doc[at >= 0], minlength=len(sizes))
                known, at = counts > 0, at[at >= 0]
                sums = _sums(matrix, at, (np.cumsum(counts) - counts)[known], counts[known])
                norms = np.sqrt(np.einsum("nd,nd->n", sums, sums))
                sums /= np.where(norms == 0, 1, norms)[:, None]
                ends = np.r_[0, np.cumsum(known) * matrix.shape[1]].astype(np.int32)
                columns[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, schema)


def phrase_vectors(phrases: DataFrame, words: DataFrame, **options) -> DataFrame:
    """``phrase, vec``: unit vectors of phrases whose every word is known."""
    known = phrases_in_vocabulary(phrases, words)
    sums = sum_word_vectors(known, words, "phrase", **options)
    return sums.select("phrase", l2_normalize("total").alias("vec"))


def stemmed_tokens(df: DataFrame, key: str = "id", title: str = "title", stop_words=()) -> DataFrame:
    """``key, tokens`` with every token replaced by its stem, then stop words dropped.

    Each distinct token is stemmed once and joined back. Every document stays.
    """
    spelled = df.select(key, F.posexplode(word_tokens(clean_text(F.col(title)))).alias("pos", "word"))
    stems = with_stems(spelled.select("word").distinct(), "word")
    stop = list(stop_words)
    joined = spelled.join(stems, "word")
    if stop:
        joined = joined.where(~F.col("stem").isin(stop))
    stemmed = (
        joined.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("t"))
        .select(key, F.col("t.stem").alias("tokens"))
    )
    none = F.array().cast("array<string>")
    return df.select(key).join(stemmed, key, "left").select(key, F.coalesce("tokens", none).alias("tokens"))
