"""Tokens, vocabularies and term statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from kindred.functions.text import product_words, title_tokens
from kindred.functions.wordlists import ENGLISH_STOP_WORDS
from kindred.session import materialise, unbroadcast

BROADCAST_WORDS = 1_000_000


def with_title_tokens(
    df: DataFrame, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, title: str = "title"
) -> DataFrame:
    """Add ``tokens``: cleaned title words without stop words, repeats kept."""
    return df.withColumn("tokens", title_tokens(F.col(title), stop_words))


def each_token(docs: DataFrame, *keys: str, tokens: str | Column = "tokens", places: bool = False) -> DataFrame:
    """``keys, word`` (``places``: ``keys, pos, word``), one row per token that is not null.

    An inner ``explode`` lets Spark derive a filter on the number of tokens, which
    is pushed below a repartition with the whole cleaning chain in it: the chain
    then runs twice. The outer form, cut afterwards, computes tokens once.
    """
    word = F.posexplode_outer(tokens).alias("pos", "word") if places else F.explode_outer(tokens).alias("word")
    return docs.select(*keys, word).where(F.col("word").isNotNull())


def vocabulary_tokens(
    docs: DataFrame, words: DataFrame, key: str = "id", max_broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """``key, tokens`` with only the tokens found in ``words``, order and repeats
    kept. Documents without any such token disappear; rows that share a key are one.

    A vocabulary counted to be at most ``max_broadcast_words`` goes to every
    executor, and tokens stay where they are but for rows that share a key.
    """
    words = words.select("word").distinct()
    docs = docs.select(key, "tokens")
    if words.count() > max_broadcast_words:
        return _joined_vocabulary_tokens(docs, words, key)
    index = pd.Index(words.toArrow().column("word").to_pandas())
    shared = docs.sparkSession.sparkContext.broadcast(index)
    again = docs.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again")
    again = materialise(again, "repeated-keys")
    if again.isEmpty():
        return docs.mapInArrow(_filtering_batches(shared, min_tokens=1), docs.schema)
    same = F.col(key).eqNullSafe(F.col("_again"))
    once = docs.join(again, same, "left_anti").mapInArrow(_filtering_batches(shared, min_tokens=1), docs.schema)
    return once.unionByName(_joined_vocabulary_tokens(docs.join(again, same, "left_semi"), words, key))


def _joined_vocabulary_tokens(docs: DataFrame, words: DataFrame, key: str) -> DataFrame:
    spelled = each_token(docs, key, places=True)
    return (
        spelled.join(words.select("word"), "word", "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t"))
        .select(key, F.col("t.word").alias("tokens"))
    )


def _filtering_batches(shared, min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            lists = batch.column("tokens")
            words = lists.flatten()
            known = index.get_indexer(words.to_pandas()) >= 0
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            ends = np.r_[0, np.cumsum(known)][np.r_[0, np.cumsum(sizes)]].astype(np.int32)
            tokens = pa.ListArray.from_arrays(ends, words.filter(pa.array(known)))
            at = batch.schema.get_field_index("tokens")
            batch = batch.set_column(at, "tokens", tokens.cast(batch.schema.field(at).type))
            yield batch.filter(pa.array(np.diff(ends) >= min_tokens))

    return run


def keep_vocabulary_tokens(
    df: DataFrame, words: DataFrame, key: str = "id", max_broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """Restrict ``tokens`` to the vocabulary and drop rows left without any.

    A vocabulary counted to be at most ``max_broadcast_words`` goes to every
    executor and rows stay where they are; a larger one is joined by word. A word
    listed several times counts as one. With the join, ``key`` must be unique.
    """
    words = words.select("word").distinct()
    if words.count() > max_broadcast_words:
        kept = vocabulary_tokens(df, words, key, max_broadcast_words)
        return df.drop("tokens").join(kept, key).select(*df.columns)
    index = pd.Index(words.select("word").toArrow().column("word").to_pandas())
    shared = df.sparkSession.sparkContext.broadcast(index)
    return df.mapInArrow(_filtering_batches(shared, min_tokens=1), df.schema)


def token_counts(corpus: DataFrame, min_count: int = 1) -> DataFrame:
    """``word, count`` over all tokens, for words seen at least ``min_count`` times."""
    return (
        each_token(corpus)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= min_count)
    )


def document_frequency(docs: DataFrame) -> DataFrame:
    """``word, df``: documents that contain the word. Repeats inside a document
    are removed in place, so the count needs no distinct shuffle."""
    return (
        each_token(docs, tokens=F.array_distinct("tokens"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def term_frequency(docs: DataFrame, key: str = "id") -> DataFrame:
    """``key, word, tf``."""
    return (
        each_token(docs, key)
        .groupBy(key, "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def tfidf(
    docs: DataFrame, key: str = "id", smooth: bool = False, max_df: float | None = None,
    max_broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """``key, word, tf, df, weight`` with unit-length weights per document.

    Plain: ``tf * log2(N / df)``, terms found in every document dropped.
    ``smooth``: ``tf * (ln((1 + N) / (1 + df)) + 1)``. ``max_df`` drops terms in
    more than that share of the documents. ``key`` must be unique.

    Tokens are read once: the counts of each document are written out as one row, and both
    the document frequencies and the weights come from there. A vocabulary counted to be at
    most ``max_broadcast_words``, but for words of a single document, goes to every executor,
    and terms stay where their document is; with a larger one they are joined by word.
    """
    n = docs.count()
    found = materialise(_counted_terms(docs, key), "term-counts")
    df = F.col("df")
    if smooth:
        idf, kept = F.log((1 + F.lit(n)) / (1 + df)) + 1, F.lit(True)
    else:
        idf, kept = F.log2(F.lit(n) / df), df < n
    if max_df is not None:
        kept = kept & (df <= max_df * F.lit(n))
    valued = lambda counts: counts.withColumn("idf", F.when(kept, idf))
    counts = materialise(each_token(found, tokens="words").groupBy("word").agg(F.count(F.lit(1)).alias("df")), "document-counts")
    every, several = counts.agg(F.count(F.lit(1)), F.count_if(df > 1)).first()
    if several > max_broadcast_words:
        spelled = found.select(key, F.explode(F.arrays_zip("words", "tfs")).alias("t")).select(key, F.col("t.words").alias("word"), F.col("t.tfs").alias("tf"))
        raw = F.col("tf") * F.col("idf")
        norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(key)))
        weighted = spelled.join(unbroadcast(valued(counts).where("idf IS NOT NULL")), "word")
        return weighted.select(key, "word", "tf", "df", (raw / norm).alias("weight"))
    # where single words are left out, any word not in the list is one of them
    single = None if every <= max_broadcast_words else valued(docs.sparkSession.range(1).select(F.lit(1).alias("df"))).first()["idf"]
    listed = valued(counts if every <= max_broadcast_words else counts.where(df > 1)).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (pd.Index(listed.column("word").to_pandas()), listed.column("df").to_numpy(), listed.column("idf").to_numpy(), single)
    )
    fields = [found.schema[key], StructField("word", StringType()), *(StructField(c, LongType()) for c in ("tf", "df")), StructField("weight", DoubleType())]
    return found.mapInArrow(_weighing(shared, key), StructType(fields))


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(sizes)), sizes)


def _counted_terms(docs: DataFrame, key: str) -> DataFrame:
    """``key, words, tfs``: one row per key with its distinct words and how often each occurs.
    Only documents that share a key are shuffled."""
    docs = docs.select(key, "tokens")
    schema = StructType([docs.schema[key], StructField("words", ArrayType(StringType())), StructField("tfs", ArrayType(LongType()))])
    again = docs.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again")
    again = materialise(again, "repeated-keys")
    if again.isEmpty():
        return docs.mapInArrow(_counting(key), schema)
    same = F.col(key).eqNullSafe(F.col("_again"))
    merged = (
        term_frequency(docs.join(again, same, "left_semi"), key)
        .groupBy(key)
        .agg(F.collect_list("word").alias("words"), F.collect_list("tf").alias("tfs"))
    )
    return docs.join(again, same, "left_anti").mapInArrow(_counting(key), schema).unionByName(merged)


def _counting(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, there = _rows_of(lists), codes >= 0
            width = max(1, len(coded.dictionary))
            terms, tfs = np.unique(rows[there] * width + codes[there], return_counts=True)
            ends = np.searchsorted(terms, np.arange(batch.num_rows + 1) * width).astype(np.int32)
            words = coded.dictionary.take(pa.array(terms % width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                names=[key, "words", "tfs"],
            )

    return run


def _weighing(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, dfs, idfs, single = shared.value
        # the last place is that of words not listed
        dfs, idfs = np.append(dfs, 1), np.append(idfs, np.nan if single is None else single)
        for batch in (b.slice(start, 2048) for b in batches for start in range(0, b.num_rows, 2048)):
            lists = batch.column("words")
            rows, words = _rows_of(lists), lists.flatten()
            coded = words.dictionary_encode()
            place = index.get_indexer(coded.dictionary.to_pandas())[coded.indices.to_numpy()]
            tf, idf = batch.column("tfs").flatten().to_numpy(), idfs[place]
            kept = np.flatnonzero(~np.isnan(idf))
            rows, raw = rows[kept], (tf * idf)[kept]
            norms = np.sqrt(np.bincount(rows, raw * raw, batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows)), words.take(pa.array(kept)), pa.array(tf[kept]), pa.array(dfs[place][kept]), pa.array(raw / norms[rows])],
                names=[key, "word", "tf", "df", "weight"],
            )

    return run


def top_values(df: DataFrame, column: str, limit: int = 80) -> DataFrame:
    """The most frequent non-null values (ties by value): ``value, count``."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(limit)
    )


def phrases_in_vocabulary(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrase, tokens`` of the phrases whose every word is known."""
    spelled = phrases.withColumn("tokens", product_words(F.col("phrase")))
    unknown = (
        spelled.select("phrase", F.explode("tokens").alias("word"))
        .join(words.select("word"), "word", "left_anti")
        .select("phrase")
    )
    return spelled.join(unknown, "phrase", "left_anti")
