"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its
letters' vectors, each rotated by its distance from the end; a text is the sum of
its n-grams; a language is the sum of the texts it is learned from. The language
whose profile has the largest cosine with the text's vector is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices

LETTERS = 128


@dataclass(frozen=True)
class Profiles:
    """Three letters per n-gram, ``size`` components per vector."""

    size: int = 1024
    seed: int = 7


@cache
def _letter_codes() -> np.ndarray:
    """Code of every code point: 0 if it is no letter, a-z 1 to 26, other letters spread over the rest."""
    codes = np.zeros(0x110000, np.uint32)
    points = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.uint64)
    codes[points.astype(np.int64)] = 27 + (points * np.uint64(2654435761) >> np.uint64(11)) % np.uint64(LETTERS - 27)
    codes[97:123] = np.arange(1, 27)
    return codes


@cache
def _letter_vectors(size: int, seed: int) -> list[np.ndarray]:
    """Vectors of the letters, rotated by 2, 1 and 0 places."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, size))
    return [np.roll(base, shift, 1) for shift in (2, 1, 0)]


def gram_vectors(grams: np.ndarray, spec: Profiles) -> np.ndarray:
    a, b, c = _letter_vectors(spec.size, spec.seed)
    return (a[grams >> 14] * b[grams >> 7 & 127] * c[grams & 127]).astype(np.float32)


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, n-gram and count; and, as third, which texts have a letter.

    Runs of other characters count as one blank; each text has a blank at either end.
    """
    codes = _letter_codes()
    owner, grams, letters = [], [], np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if text:
            c = codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
            letters[i] = c.any()
            if letters[i]:
                c = np.concatenate([[0], c, [0]]).astype(np.uint32)
                c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
                grams.append(c[:-2] << np.uint32(14) | c[1:-1] << np.uint32(7) | c[2:])
                owner.append(np.full(len(grams[-1]), i, np.int64))
    keys = np.concatenate(owner or [np.zeros(0, np.int64)]) << 21 | np.concatenate(grams or [np.zeros(0, np.int64)]).astype(np.int64)
    keys, count = np.unique(keys, return_counts=True)
    return np.stack([keys >> 21, keys & ((1 << 21) - 1), count]), letters


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, spec: Profiles = Profiles()) -> tuple[list[str], np.ndarray]:
    """Languages in order and their profiles, one vector per language, from all rows that have a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            names = part.column("lang").dictionary_encode()
            (owner, grams, n), _ = text_grams(part.column("text").to_pylist())
            keys, place = np.unique(names.indices.to_numpy()[owner].astype(np.int64) << 21 | grams, return_inverse=True)
            lang = names.dictionary.take(pa.array(keys >> 21))
            total = np.bincount(place, n, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([lang, pa.array(keys & ((1 << 21) - 1)), pa.array(total)], ["lang", "gram", "n"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            grams, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            for name in dict.fromkeys(lang):
                own = np.flatnonzero(lang == name)
                for i in range(0, len(own), 2000):
                    rows = own[i : i + 2000]
                    sums[name] = sums.get(name, 0.0) + n[rows].astype(np.float64) @ gram_vectors(grams[rows], spec)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "vector"])

    counts = docs.where("lang is not null").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counts.mapInArrow(bundle, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("dim", "value"))
    rows = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    names = sorted(rows["lang"].unique())
    out = np.zeros((len(names), spec.size))
    out[np.searchsorted(names, rows["lang"]), rows["dim"]] = rows["value"]
    return names, out


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray, spec: Profiles = Profiles()) -> DataFrame:
    """``doc_id, lang_pred, score``, the cosine cut at 0 and 1, of whole texts.

    Texts that are null or have no letter, and all texts if no language was
    learned, give ``und`` and 0. Of equal cosines the first language by name wins.
    Repeated rows get equal results; an empty table gives none.
    """
    unit = (profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            (owner, grams, n), letters = text_grams(part.column("text").to_pylist())
            used, place = np.unique(grams, return_inverse=True)
            vectors = np.zeros((len(part), spec.size), np.float32)
            for i in range(0, len(used), 4096):
                own = (place >= i) & (place < i + 4096)
                weight = np.zeros((len(part), min(4096, len(used) - i)), np.float32)
                weight[owner[own], place[own] - i] = n[own]
                vectors += weight @ gram_vectors(used[i : i + 4096], spec)
            lang, score = ["und"] * len(part), np.zeros(len(part))
            if len(names):
                cosine = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
                best = cosine.argmax(1)
                score = np.where(letters, np.clip(cosine[np.arange(len(part)), best], 0, 1), 0).astype(np.float64)
                lang = [names[b] if ok else "und" for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, spec: Profiles = Profiles()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows that are not held out, for all rows."""
    learned = learn(docs.where(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), spec)
    out = predict(docs, *learned, spec)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
