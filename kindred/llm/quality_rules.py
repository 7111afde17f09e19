"""Quality rules: repetition and symbol counts, then a likelihood ratio of hashed n-grams.

Two multinomials over hashed word 1-grams and 2-grams are estimated: one from
trusted documents, one from the whole corpus. The score of a document is the sum
of ``log p_trusted - log p_corpus`` over its n-grams, divided by their number.
The trusted documents are split: most give the counts, the rest the threshold, a
low quantile of their scores. It is the same for every document of a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import mix64, per_text, slices, span_hashes, text_bytes, word_spans
from kindred.session import materialise, unbroadcast

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
OUTPUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """One in ``held_out`` of the trusted documents sets the threshold: the ``quantile`` of
    their scores less ``margin``; a ``threshold`` that is given is used instead.
    """

    buckets: int = 1 << 15
    held_out: int = 4
    quantile: float = 0.001
    margin: float = 0.01
    threshold: float | None = None
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def _grams(hashes: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every 1-gram and 2-gram."""
    same = doc[1:] == doc[:-1]
    pairs = mix64(hashes[:-1] * np.uint64(31) + hashes[1:])[same]
    grams = np.concatenate([hashes, pairs]) & np.uint64(buckets - 1)
    return grams.astype(np.int64), np.concatenate([doc, doc[:-1][same]])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[place] > 1


def base_counts(data: np.ndarray, offsets: np.ndarray, starts, ends, doc, hashes, window: int) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    of_doc = mix64(np.arange(1, n + 1, dtype=np.uint64))
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = np.bincount(doc, lead[ends] - lead[starts], n).astype(np.int64)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]))
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]))
    seen = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    full = seen > 0
    lines = span_hashes(data, line_starts[full], line_ends[full]) ^ of_doc[owner[full]]
    _, firsts = np.unique(lines, return_index=True)
    duplicate = np.bincount(owner[full], minlength=n) - np.bincount(owner[full][firsts], minlength=n)

    repeated = np.zeros(n, np.int64)
    if len(hashes) >= window:
        last = len(hashes) - window + 1
        inside = doc[:last] == doc[window - 1 :]
        rolled = np.zeros(last, np.uint64)
        for i in range(window):
            rolled = rolled * np.uint64(0x100000001B3) + hashes[i : i + last]
        at = np.flatnonzero(inside)
        at = at[_repeats(mix64(rolled[at]) ^ of_doc[doc[at]])]
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        repeated = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": chars,
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": duplicate,
        "n_repeat_words": repeated,
    }


def _words(column: pa.Array):
    data, offsets = text_bytes(column)
    starts, ends, doc = word_spans(data, offsets)
    return data, offsets, starts, ends, doc, span_hashes(data, starts, ends)


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, n)`` over all texts: one count vector per task, then a sum per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            *_, doc, hashes = _words(part.column("text"))
            total += np.bincount(_grams(hashes, doc, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, rules: Rules) -> tuple[np.ndarray, float]:
    """Log ratio per bucket, a vector of fixed size, and the threshold. Without trusted documents both are zero."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(rules.held_out)) == 0
    likely = _likely(docs.select("doc_id", "text"), trusted)
    # written out, as these texts should move once; a semi join would be moved before the bitmap by Spark
    chosen = materialise(likely.join(unbroadcast(trusted), "doc_id").select("doc_id", "text", held.alias("held")), "trusted")
    counts = gram_counts(docs, rules.buckets).withColumn("kind", F.lit(0))
    counts = counts.union(gram_counts(chosen.where("not held"), rules.buckets).withColumn("kind", F.lit(1)))
    rows = counts.toPandas()
    corpus, good = both = np.zeros((2, rules.buckets))
    both[rows["kind"], rows["bucket"]] = rows["n"]
    if not good.any():
        return np.zeros(rules.buckets), rules.threshold or 0.0
    corpus = (corpus + 1) / (corpus.sum() + rules.buckets)
    # smoothed towards the corpus with as much weight as the counts: what a small sample lacks is little evidence
    weight = rules.buckets + good.sum()
    ratio = np.log((good + weight * corpus) / (good.sum() + weight)) - np.log(corpus)
    if rules.threshold is not None:
        return ratio, rules.threshold
    rest = chosen.where("held").select("doc_id", "text")
    scores = rest.mapInArrow(_scorer(ratio, 0.0, rules), OUTPUT).where("not base_failed")
    return ratio, min(0.0, (quantile(materialise(scores.select("llr"), "held-scores"), "llr", rules.quantile) or 0.0) - rules.margin)


def _likely(docs: DataFrame, trusted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows whose hashed id is one of the trusted ones', by a bitmap of fixed size: few other texts move for the join."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    marks = trusted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    spot = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.join(F.broadcast(marks), F.bitmap_bucket_number(place) == F.col("bucket"))
    return marked.where(F.floor(byte / F.pow(F.lit(2), spot % 8)).cast("int") % 2 == 1).select(*docs.columns)


def quantile(rows: DataFrame, column: str, share: float, accuracy: int = 10_000) -> float | None:
    """Exact quantile with interpolation. A sketch bounds it from above, and only rows up to that bound are ordered."""
    n = rows.agg(F.count(column)).first()[0]
    if not n:
        return None
    place = share * (n - 1)
    bound = rows.agg(F.percentile_approx(column, min(1.0, (place + 2) / n + 10 / accuracy), accuracy)).first()[0]
    low = rows.where(F.col(column) <= bound)
    held = low.agg(F.count(column)).first()[0]
    return low.agg(F.percentile(column, F.lit(min(1.0, place / max(1, held - 1))))).first()[0]


def judge(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: base counts, base verdict, score and final verdict.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id, quality, toxic``;
    other columns are ignored. A null or empty text has no words and fails. Equal
    rows get equal results, each its own row; an empty table gives none. A null
    ``doc_id`` is kept as null.
    """
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_scorer(*fit(docs, labels, rules), rules), OUTPUT)


def _scorer(ratio: np.ndarray, threshold: float, rules: Rules):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets, starts, ends, doc, hashes = _words(part.column("text"))
            n = len(part)
            out = base_counts(data, offsets, starts, ends, doc, hashes, rules.window)
            grams, owner = _grams(hashes, doc, rules.buckets)
            size = np.bincount(owner, minlength=n)
            llr = np.bincount(owner, ratio[grams], n) / np.maximum(size, 1)
            failed = (out["n_words"] < rules.min_words) | (
                100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"]
            )
            out |= {"base_failed": failed, "llr": llr, "kept": ~failed & (llr >= threshold)}
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in out.values())], ["doc_id", *out]
            )

    return score


def keep_good(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns. The verdict is computed next to the row: nothing is joined."""
    score = _scorer(*fit(docs.select("doc_id", "text"), labels, rules), rules)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            verdict = next(score(iter([part.select(["doc_id", "text"])])), None)
            if verdict is not None:
                yield part.filter(verdict.column("kept"))

    return docs.mapInArrow(keep, docs.schema)
