"""Byte-level BPE: chunks cut at their own pre-token boundaries, stitched, encoded.

Long texts are cut into overlapping chunks that are dealt out to all tasks. Each
chunk is pre-tokenised from its own first character, as if a text began there,
and so is the overlap that it shares with the next one. The first boundary that
both agree on is the seam: a match depends on what follows it only, so behind a
common boundary both have the same pre-tokens. The pieces between two seams are
then encoded, in parallel again. Where no boundary is common, one pre-token is
longer than the overlap, and the text is cut anew into longer chunks.

Pieces are merged by the ranks of the vocabulary, the lowest rank first, the
leftmost of equal ones first. Unseen pieces are merged together, one numpy step
per merge; long ones have a heap of their own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import slices
from kindred.session import materialise

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A match of the pattern is settled once this many characters behind its end are known.
MARGIN = 2
#: A vocabulary goes to every task, so its file may not be larger.
VOCABULARY_BYTES = 64 << 20
NEVER = np.int32(2**31 - 1)


class Merges:
    """The tokens of a vocabulary, and which two of them make a third."""

    def __init__(self, tokens: list[bytes], remember: int = 300_000, longest: int = 64):
        self.tokens, self.remember, self.longest = tokens, remember, longest
        self.ids = {token: i for i, token in enumerate(tokens) if token}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = i
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], np.int32)
        #: Ids of pieces, as the bytes of 32-bit numbers.
        self.known: dict[str, bytes] = {}

    def encode(self, cut: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts that are cut into pieces."""
        passing = self._learn(set(chain.from_iterable(cut)))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, pieces)), np.int32) for pieces in cut]
        for piece in passing:
            del self.known[piece]
        return out

    def _learn(self, pieces: set[str], cells: int = 1 << 17) -> list[str]:
        """Fill ``known`` for these pieces; returns the long ones, which are not to be remembered."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = list(pieces)
        short, passing = [], []
        for piece in new:
            data = piece.encode()
            whole = self.ids.get(data)
            if whole is not None:
                self.known[piece] = np.int32(whole).tobytes()
            elif len(data) <= self.longest:
                short.append((len(data), piece, data))
            else:
                self.known[piece] = self._alone(data)
                passing.append(piece)
        short.sort()
        while short:
            # the longest first, so that pieces of about one length are padded together
            take = max(1, cells // short[-1][0])
            part = short[-take:]
            del short[-take:]
            self.known.update(zip((p for _, p, _ in part), self._together([d for _, _, d in part])))
        return passing

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What the pairs merge to, which is also their rank; ``NEVER`` if to nothing."""
        key = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (left >= 0) & (right >= 0), self.made[place], NEVER)

    def _together(self, words: list[bytes]) -> Iterator[bytes]:
        size = len(words[-1])
        lengths = np.array([len(w) for w in words])
        ids = np.full((len(words), size + 1), -1, np.int32)
        ids[:, :-1][np.arange(size) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(ids.shape, NEVER)
        ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        out = np.full(ids.shape, -1, np.int32)
        rows, at = np.arange(len(words)), np.arange(size + 1)
        while len(rows):
            first = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, first]
            open_ = best < NEVER
            if not open_.all():
                out[rows[~open_], : ids.shape[1]] = ids[~open_]
                rows, ids, ranks, first, best = rows[open_], ids[open_], ranks[open_], first[open_], best[open_]
                every = every[: len(rows)]
                if not len(rows):
                    break
            # both halves become one; what follows moves up by one place
            take = np.minimum(at[None, :-1] + (at[None, :-1] > first[:, None]), size)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            size, at = size - 1, at[:-1]
            ids[every, first] = best
            after = np.minimum(first + 1, size)
            ranks[every, first] = np.where(after > first, self._rank(best, ids[every, after]), NEVER)
            before = first > 0
            left = first[before] - 1
            ranks[every[before], left] = self._rank(ids[every[before], left], best[before])
        data, width = out.tobytes(), 4 * out.shape[1]
        for row, n in enumerate((out >= 0).sum(axis=1).tolist()):
            yield data[row * width : row * width + 4 * n]

    def _alone(self, data: bytes) -> bytes:
        """The same for one long piece: pairs wait in a heap, places are chained."""
        ids: list[int] = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(made, i) for i in range(n - 1) if (made := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            made, i = heapq.heappop(queue)
            j = after[i]
            # a pair that has changed since it was queued is queued again with its new rank
            if ids[i] < 0 or j < 0 or get(ids[i] << 32 | ids[j]) != made:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (new := get(made << 32 | ids[k])) is not None:
                    heapq.heappush(queue, (new, i))
            h = before[i]
            if h >= 0 and (new := get(ids[h] << 32 | made)) is not None:
                heapq.heappush(queue, (new, h))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()


_loaded: dict[str, Merges] = {}


def _merges(shared) -> Merges:
    """The merges of this worker process, made once per vocabulary."""
    name, tokens = shared.value
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Merges(tokens)
    return _loaded[name]


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines ``base64 rank``; places without a token are empty."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def _share(spark: SparkSession, path: str):
    tokens = read_vocabulary(path)
    return spark.sparkContext.broadcast((hashlib.sha256(repr(tokens).encode()).hexdigest(), tokens))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32)))


def _cutting(size: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of texts; each but the last reaches ``overlap`` characters into the next."""
    names = ["row", "doc_id", "chunk", "last", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for start in range(0, len(text), 16 * size):
                    at = range(start, min(len(text), start + 16 * size), size)
                    columns = [
                        pa.array([row] * len(at), pa.int64()), pa.array([doc] * len(at), pa.int64()),
                        pa.array([a // size for a in at], pa.int32()), pa.array([a + size >= len(text) for a in at]),
                        pa.array([text[a : a + size + overlap] for a in at], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def seam(ends: np.ndarray, ahead: np.ndarray, size: int, known: int) -> int | None:
    """Where the next chunk begins to agree, counted from its begin; None if nowhere.

    ``ends`` are the boundaries of this chunk, ``ahead`` those that the next one
    finds in the overlap, counted from its begin; ``known`` characters are seen
    by both. Boundaries that a longer look could move do not count.
    """
    own = ends[(ends >= size) & (ends <= known - MARGIN)] - size
    both = own[np.isin(own, np.r_[0, ahead])]
    return int(both[0]) if len(both) else None


def _pretokenising(pattern: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["row", "doc_id", "chunk", "last", "text", "lengths", "seam"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in batches:
            for part in slices([batch], "text"):
                lengths, seams = [], []
                for text, last in zip(part.column("text").to_pylist(), part.column("last").to_pylist()):
                    sizes = np.array([*map(len, find(text))], np.int32)
                    if last:
                        lengths.append(sizes)
                        seams.append(None)
                        continue
                    ends = np.cumsum(sizes)
                    ahead = np.cumsum([*map(len, find(text[size:]))], dtype=np.int64)
                    found = seam(ends, ahead, size, len(text))
                    seams.append(found)
                    lengths.append(sizes[ends <= size + found] if found is not None else sizes[:0])
                columns = [part.column(c) for c in names[:5]] + [_lists(lengths), pa.array(seams, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _encoding_pieces(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["row", "doc_id", "chunk", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared)
        for batch in batches:
            for part in slices([batch], "text"):
                cut = []
                for text, sizes, begin in zip(part.column("text").to_pylist(), part.column("lengths"), part.column("begin").to_pylist()):
                    ends = np.cumsum(sizes.values.to_numpy(), dtype=np.int64)
                    ends = [begin, *ends[ends > begin].tolist()]
                    cut.append([text[a:b] for a, b in zip(ends, ends[1:])])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), _lists(merges.encode(cut))], names)

    return run


def _encoding_texts(shared, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, find = _merges(shared), regex.compile(pattern).findall
        for part in slices(batches, "text"):
            cut = [find(text) if text else [] for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(merges.encode(cut))], ["doc_id", "ids"])

    return run


def encode(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN,
    chunk: int = 1 << 16, overlap: int = 1 << 11,
) -> DataFrame:
    """``doc_id, ids`` of every row: each match of ``pattern`` in the whole text, encoded by itself.

    Texts of more than ``chunk`` bytes are cut into chunks of that many characters,
    which overlap by ``overlap``. A text whose chunks find no common boundary is
    cut anew into chunks eight times as long, with overlaps to match, until one
    chunk holds it. ``pattern`` must match any text without gaps, may look behind
    nothing, and no further than two characters behind a match.

    A null or empty text has no ids. Rows that repeat an id or a whole row are
    encoded each by itself, and so are rows without an id. Of equal ranks the
    leftmost pair merges first. An empty table gives none; other columns are
    ignored.
    """
    if not 2 * MARGIN < overlap <= chunk:
        raise ValueError("the overlap must be longer than 4 characters and no longer than a chunk")
    spark = docs.sparkSession
    shared = _share(spark, vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    out = rows.where(~is_long).mapInArrow(_encoding_texts(shared, pattern), "doc_id long, ids array<int>")
    # rows are numbered once and for all: a lost task would number them anew
    left = materialise(rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long-texts")
    while not left.isEmpty():
        chunks = left.mapInArrow(_cutting(chunk, overlap), "row long, doc_id long, chunk int, last boolean, text string")
        cut = materialise(
            chunks.repartition(F.xxhash64("row", "chunk")).mapInArrow(
                _pretokenising(pattern, chunk), "row long, doc_id long, chunk int, last boolean, text string, lengths array<int>, seam int"
            ),
            "chunks",
        )
        apart = cut.where("NOT last AND seam IS NULL").select("row").distinct()
        # three numbers a chunk: the seam before it is where its pieces begin
        before = F.coalesce(F.lag("seam").over(Window.partitionBy("row").orderBy("chunk")), F.lit(0))
        begins = cut.select("row", "chunk", before.alias("begin"))
        pieces = cut.join(apart, "row", "left_anti").join(begins, ["row", "chunk"])
        ids = pieces.select("row", "doc_id", "chunk", "text", "lengths", "begin").mapInArrow(
            _encoding_pieces(shared), "row long, doc_id long, chunk int, ids array<int>"
        )
        parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))["ids"]
        out = out.unionByName(ids.groupBy("row", "doc_id").agg(F.flatten(parts).alias("ids")).select("doc_id", "ids"))
        left = left.join(apart, "row", "left_semi")
        chunk, overlap = 8 * chunk, 8 * overlap
    return out


def decoder(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``decode`` does to record batches, to be joined with other steps of one task."""
    shared = _share(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = shared.value
        # the last place, and so every id beyond the vocabulary, has no token
        get = np.array([*tokens, b""], object)
        for batch in batches:
            data = []
            for ids in batch.column("ids"):
                ids = ids.values.to_numpy() if ids.is_valid else None
                found = None if ids is None else get[np.minimum(ids.astype(np.uint32), len(tokens))].tolist()
                if found and not all(found):
                    raise ValueError("an id has no token")
                data.append(None if found is None else b"".join(found))
            columns = {name: batch.column(name) for name in batch.schema.names if name != "data"}
            yield pa.RecordBatch.from_pydict({**columns, "data": pa.array(data, pa.binary())})

    return run


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns and ``data``: the bytes of the tokens ``ids``, one after the other; null stays null.

    An id without a token is an error.
    """
    schema = T.StructType([f for f in encoded.schema if f.name != "data"] + [T.StructField("data", T.BinaryType())])
    return encoded.mapInArrow(decoder(encoded.sparkSession, vocabulary), schema)
