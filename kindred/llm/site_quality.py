"""Quality classifier: document evidence combined with the record of its site.

Document evidence: two sparse logistic models over hashed words and text shape,
one for low quality and one for toxic text, learned from a bounded labelled
sample. A document is bad if it is either.

Site evidence: hosts and paths have Beta priors. The rate of bad documents of a
host is shrunk towards the global rate, that of a path towards its host, each
with a strength estimated from how much sites differ beyond chance. A document's
own probability is taken out of its site's before it is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import lower_ascii, per_text, slices, span_hashes, text_bytes, word_spans
from kindred.session import materialise

SHAPES, BINS = 6, 12
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass(frozen=True)
class Sites:
    """``labelled_rows`` bounds the labelled sample, which is fitted on the driver in ``steps`` document steps or three passes."""

    buckets: int = 1 << 17
    labelled_rows: int = 20_000
    sparsity: float = 3.0
    rate: float = 0.1
    steps: int = 40_000
    threshold: float = 0.5
    floor: float = 1.0
    ceiling: float = 1e6


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each distinct feature: words as written, words of letters only in lower case, and shape."""
    data, offsets = text_bytes(column)
    n = len(column)
    starts, ends, doc = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    plain = np.where(LETTER[data], lower_ascii(data), np.uint8(32))
    s, e, plain_doc = word_spans(plain, offsets)
    letters = span_hashes(plain, s, e) ^ np.uint64(0x5BD1E995)
    keys = np.concatenate([doc, plain_doc]) * buckets + (np.concatenate([words, letters]) % np.uint64(buckets)).astype(np.int64)
    keys = np.unique(keys)
    size = np.maximum(np.diff(offsets), 1)
    count = np.bincount(doc, minlength=n)
    order = np.lexsort((words, doc))
    sorted_doc, sorted_words = doc[order], words[order]
    new = np.ones(len(doc), bool)
    new[1:] = (sorted_doc[1:] != sorted_doc[:-1]) | (sorted_words[1:] != sorted_words[:-1])
    distinct = np.bincount(sorted_doc[new], minlength=n)
    shape = [
        per_text(MARK[data], offsets) / size, per_text(UPPER[data], offsets) / size, per_text(data == 124, offsets) / size * 4,
        distinct / np.maximum(count, 1), np.log1p(count) / 12, size / np.maximum(count, 1) / 24,
    ]
    bins = [np.minimum((np.clip(x, 0, 1) * BINS).astype(np.int64), BINS - 1) + buckets + i * BINS for i, x in enumerate(shape)]
    return np.concatenate([keys // buckets, np.tile(np.arange(n), SHAPES)]), np.concatenate([keys % buckets, *bins])


def fit(docs: DataFrame, labels: DataFrame, spec: Sites) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and offsets of the two models, and the rate of bad documents in the labelled sample.

    Without labels of both kinds a model says nothing: probability 0.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 0).cast("int")).alias("poor"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(spec.labelled_rows)
    )

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, bucket = features(part.column("text"), spec.buckets)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(1, len(part)))
            sets = [x.astype(np.int32).tobytes() for x in np.split(bucket[order], cuts)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "poor", "toxic")), pa.array(sets, pa.binary())], ["doc_id", "poor", "toxic", "set"])

    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = sample.mapInArrow(collect, "doc_id long, poor int, toxic int, set binary").toPandas()
    # repeated rows and near copies come in any order: the fit must not depend on it
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    sets = [np.frombuffer(x, np.int32) for x in rows["set"]]
    size = spec.buckets + SHAPES * BINS
    models = [_sparse_logistic(sets, rows[c].to_numpy(float), size, spec) for c in ("poor", "toxic")]
    bad = ((rows["poor"] == 1) | (rows["toxic"] == 1)).mean() if len(rows) else 0.5
    return np.stack([w for w, _ in models]), np.array([b for _, b in models]), float(np.clip(bad, 1e-3, 1 - 1e-3))


def _sparse_logistic(sets: list[np.ndarray], y: np.ndarray, size: int, spec: Sites) -> tuple[np.ndarray, float]:
    """Logistic regression by follow-the-regularised-leader steps: few weights other than 0, and an offset."""
    if not len(y) or y.min() == y.max():
        return np.zeros(size), -np.inf
    pull, square = np.zeros(size), np.zeros(size)
    base_pull = base_square = base = 0.0
    order = np.random.default_rng(0)
    weigh = lambda z, n: np.where(np.abs(z) <= spec.sparsity, 0, (np.sign(z) * spec.sparsity - z) / ((1 + np.sqrt(n)) / spec.rate + 1))
    for _ in range(int(np.clip(spec.steps // len(y), 3, 40))):
        for i in order.permutation(len(y)):
            own = sets[i]
            z, n = pull[own], square[own]
            w = weigh(z, n)
            slope = 1 / (1 + np.exp(-np.clip(w.sum() + base, -35, 35))) - y[i]
            more = n + slope * slope
            pull[own] = z + slope - (np.sqrt(more) - np.sqrt(n)) / spec.rate * w
            square[own] = more
            base_pull += slope - (np.sqrt(base_square + slope * slope) - np.sqrt(base_square)) / spec.rate * base
            base_square += slope * slope
            base = -base_pull / ((1 + np.sqrt(base_square)) / spec.rate)
    return weigh(pull, square), float(base)


def _scorer(weights: np.ndarray, offsets: np.ndarray, rate: float, spec: Sites, carry: list[str]):
    prior = np.log(rate / (1 - rate))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, bucket = features(part.column("text"), spec.buckets)
            clean = np.ones(len(part))
            for w, offset in zip(weights, offsets):
                if np.isfinite(offset):
                    clean /= 1 + np.exp(np.clip(np.bincount(owner, w[bucket], len(part)) + offset, -30, 30))
            evidence = np.log(np.maximum(1 - clean, 1e-12)) - np.log(clean) - prior if np.isfinite(offsets).any() else np.zeros(len(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in carry), pa.array(evidence)], ["doc_id", *carry, "evidence"])

    return score


def _strength(df: DataFrame, mean: Column, spec: Sites) -> float:
    """Prior strength of units (columns ``n, bad``) around ``mean``, by moments: chance variance over what goes beyond it."""
    rate = F.col("bad") / F.col("n")
    row = df.agg(
        F.count("*").alias("units"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("between"), F.sum(F.col("n") * mean * (1 - mean)).alias("chance"),
    ).first()
    if not row["units"] or row["units"] < 2 or row["n"] * row["n"] <= row["squares"]:
        return spec.ceiling
    chance = row["chance"] / row["n"]
    beyond = (row["between"] - (row["units"] - 1) * chance) / (row["n"] - row["squares"] / row["n"])
    return float(np.clip(chance / beyond - 1, spec.floor, spec.ceiling)) if beyond > 0 else spec.ceiling


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", spec: Sites = Sites()) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, p_bad, kept`` per row of ``docs``.

    ``evidence`` is the document's log odds beyond the base rate; the rates are the
    posterior means of its host and path; ``kept`` is ``p_bad`` below the threshold.
    Null hosts and paths are sites of their own. Null and empty texts have only
    their shape as evidence. Repeated rows each count and get equal results; without
    labels of both kinds every document is kept unless its evidence says otherwise,
    which is none. An empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    weights, offsets, rate = fit(rows, labels, spec)
    prior = float(np.log(rate / (1 - rate)))
    scorer = _scorer(weights, offsets, rate, spec, ["host", "path"])
    scored = rows.mapInArrow(scorer, "doc_id long, host string, path string, evidence double")
    scored = scored.withColumn("own", 1 / (1 + F.exp(-(F.col("evidence") + prior))))
    # nulls get a key of their own, so that one equality joins them
    key = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    scored = materialise(scored.withColumn("host_key", key("host")).withColumn("path_key", key("path")), "scored")
    paths = materialise(scored.groupBy("host_key", "path_key").agg(F.count("*").cast("double").alias("n"), F.sum("own").alias("bad")), "paths")
    hosts = paths.groupBy("host_key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean = hosts.agg(F.sum("bad") / F.sum("n")).first()[0] or 0.0
    pull = _strength(hosts, F.lit(mean), spec)
    hosts = hosts.select("host_key", ((F.col("bad") + pull * mean) / (F.col("n") + pull)).alias("host_rate"))
    paths = materialise(paths.join(hosts, "host_key"), "rates")
    tie = _strength(paths, F.col("host_rate"), spec)
    out = scored.join(paths.select("host_key", "path_key", "n", "bad", "host_rate"), ["host_key", "path_key"])
    near = lambda bad, n: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (bad + tie * F.col("host_rate")) / (n + tie)))
    others = near(F.col("bad") - F.col("own"), F.col("n") - 1)
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.log(others / (1 - others)))))
    return out.select(
        "doc_id", "host", "path", "evidence", "host_rate", near(F.col("bad"), F.col("n")).alias("path_rate"), p.alias("p_bad"), (p < spec.threshold).alias("kept")
    )
