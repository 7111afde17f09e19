"""Repeated passages by a distributed merge sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts
elsewhere. Sorting a suffix at every byte would exchange many times the input,
so only sampled suffixes are sorted: every window of ``length`` bytes has one
anchor, its smallest k-mer by hash, and equal windows have equal anchors at equal
offsets. An anchor whose k-mer is unique can have no repeat and is not sorted.

Each task sorts its suffixes, front-codes them (length of the prefix shared with
the one before, then the rest) and sends one run per key range. A range merges
its runs with a loser tree whose nodes remember the prefix a loser shares with
the last winner, so no known prefix is compared again. Suffixes that meet in the
sorted order with a common k-mer are then compared window by window, with the
bytes to the left of the anchor. Windows are equal if their 64-bit hashes are.

Texts that are equal as a whole are handled once. K-mers with more occurrences
than one range should hold are not merged: their windows are counted by hash,
spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import _tables, mix64, slices, text_bytes
from kindred.llm.minhash_dedup import by_key
from kindred.session import materialise

PLACE_BITS = np.uint64(24)


@dataclass(frozen=True)
class Repeats:
    """``kmer`` bytes make an anchor. The rest bounds the work of a task, not the result."""

    length: int = 200
    kmer: int = 32
    range_rows: int = 50_000
    hot_rows: int = 100_000
    run_bytes: int = 32 << 20
    segment: int = 1 << 17


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    power, _ = _tables(max(len(data) + 1, 1 << 16))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    _, inverse = _tables(len(sums))
    return mix64((sums[starts + length] - sums[starts]) * inverse[starts])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(x)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, spec: Repeats) -> Iterator[tuple[np.ndarray, ...]]:
    """``place, first, last, hash``: each anchor with the first and last window start it stands for, and its k-mer's hash."""
    size, step = len(data), spec.segment
    ends = offsets[1:]
    for low in range(0, max(1, size - spec.length + 1), step):
        part = data[low : low + step + spec.length - 1]
        if len(part) < spec.length:
            continue
        sums = _prefix_hashes(part)
        kmers = _hashes(sums, np.arange(len(part) - spec.kmer + 1), spec.kmer)
        place = np.arange(len(kmers), dtype=np.uint64)
        best = _sliding_min((kmers >> PLACE_BITS << PLACE_BITS) | place, spec.length - spec.kmer + 1)
        starts = np.arange(len(best))
        inside = starts + low + spec.length <= ends[np.minimum(np.searchsorted(ends, starts + low, "right"), len(ends) - 1)]
        starts = starts[inside]
        at = (best[inside] & np.uint64((1 << 24) - 1)).astype(np.int64)
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([starts[new[1:] - 1], starts[-1:]])
        yield at[new] + low, starts[new] + low, last + low, kmers[at[new]]


def _heads(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first eight bytes at each place as an ordered number of 63 bits."""
    out = np.zeros(len(places), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[places + i].astype(np.uint64)
    return (out >> np.uint64(1)).astype(np.int64)


def _scan(docs: DataFrame, spec: Repeats) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            found = [*anchors(data, offsets, spec)]
            place, first, kmer = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1, 3))
            owner = np.searchsorted(offsets, first, "right") - 1
            heads = _heads(data, place)
            cut = np.searchsorted(owner, np.arange(len(part) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int64))) for x in (kmer.view(np.int64), heads, place - offsets[owner])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("same"), pa.array(np.diff(offsets)), *lists], ["doc_id", "same", "n_bytes", "kmers", "heads", "places"]
            )

    return docs.mapInArrow(scan, "doc_id long, same binary, n_bytes long, kmers array<long>, heads array<long>, places array<long>")


def front_code(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted texts, the prefix each shares with the one before and what follows it."""
    shared, rest, before = [], [], b""
    for text in texts:
        n = common_prefix(before, text, 0)
        shared.append(n)
        rest.append(text[n:])
        before = text
    return shared, rest


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to agree and not looked at."""
    n = min(len(a), len(b))
    while known < n:
        if a[known : known + 16] == b[known : known + 16]:
            known += 16
            continue
        while known < n and a[known] == b[known]:
            known += 1
        return known
    return n


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs. Each gives its texts and the prefix each shares with the one before.

    Returns ``(run, place)`` in order and the prefix each text shares with the
    one before it in that order. Equal texts come in the order of runs.
    """
    width = 1
    while width < len(runs):
        width *= 2
    texts = [r[0] for r in runs] + [[]] * (width - len(runs))
    place = [0] * width
    # shared[r]: the prefix the head of run r has in common with the last winner; -1 once the run is used up
    shared = [0 if t else -1 for t in texts]
    losers = [0] * width

    def wins(a: int, b: int) -> int:
        """Which head is smaller, both sharing ``shared`` bytes with the last winner; the loser learns its prefix with the other."""
        if shared[a] != shared[b]:
            return a if shared[a] > shared[b] else b
        if shared[a] < 0:
            return a
        x, y = texts[a][place[a]], texts[b][place[b]]
        n = common_prefix(x, y, shared[a])
        if n == len(x) == len(y):
            first = a < b
        else:
            first = n == len(x) or (n < len(y) and x[n] < y[n])
        shared[b if first else a] = n
        return a if first else b

    def build(node: int) -> int:
        if node >= width:
            return node - width
        a, b = build(2 * node), build(2 * node + 1)
        won = wins(a, b)
        losers[node] = b if won == a else a
        return won

    top = build(1) if width > 1 else 0
    order, prefixes = [], []
    while shared[top] >= 0:
        order.append((top, place[top]))
        prefixes.append(shared[top])
        place[top] += 1
        i = place[top]
        shared[top] = runs[top][1][i] if i < len(texts[top]) else -1
        node = (top + width) // 2
        while node:
            other = losers[node]
            if wins(top, other) == other:
                losers[node], top = top, other
            node //= 2
    return order, prefixes


@dataclass(frozen=True)
class Ranges:
    """Key ranges of suffixes: between ``splits`` of their first bytes. A head that alone overfills a
    range has several of its own, by the hash of the k-mer: only equal k-mers must meet."""

    splits: np.ndarray
    full: np.ndarray
    parts: np.ndarray

    def of(self, heads: np.ndarray, kmers: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.splits, heads, "right")
        if len(self.full):
            at = np.minimum(np.searchsorted(self.full, heads), len(self.full) - 1)
            begins = len(self.splits) + 1 + np.cumsum(self.parts) - self.parts
            own = begins[at] + (mix64(kmers) % self.parts[at].astype(np.uint64)).astype(np.int64)
            out = np.where(self.full[at] == heads, own, out)
        return out


def _ranges(repeated: DataFrame, rows: int, spec: Repeats) -> Ranges:
    """Ranges of about ``range_rows`` suffixes. Their number, which is what the driver learns, is the rows' divided by that."""
    ranges = max(1, -(-rows // spec.range_rows))
    if ranges == 1:
        return Ranges(*(np.zeros(0, np.int64),) * 3)
    cuts = repeated.agg(F.percentile_approx("heads", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    heads = repeated.groupBy("heads").agg(F.count("*").alias("n")).where(F.col("n") > spec.range_rows).orderBy("heads").collect()
    full = np.array([r.heads for r in heads], np.int64)
    return Ranges(np.unique(np.array(cuts or [], np.int64)), full, np.array([-(-r.n // spec.range_rows) for r in heads], np.int64))


def _runs(texts: DataFrame, ranges: Ranges, spec: Repeats) -> DataFrame:
    """Sorted, front-coded runs of suffixes, one row per key range and run."""
    names = ["range", "shared", "sizes", "rest", "lefts", "left", "rows", "places", "spans"]

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for item in held:
            found.setdefault(item[0], []).append(item)
        rows = []
        for key, items in found.items():
            items.sort(key=lambda x: x[1])
            shared, rest = front_code([x[1] for x in items])
            pack = lambda values, kind: np.array(values, kind).tobytes()
            rows.append(
                (key, pack(shared, np.uint16), pack([len(r) for r in rest], np.uint16), b"".join(rest), pack([len(x[2]) for x in items], np.uint16),
                 b"".join(x[2] for x in items), pack([x[3] for x in items], np.int64), pack([x[4] for x in items], np.int64), pack([x[5] for x in items], np.int16))
            )
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            raw, ids = data.tobytes(), part.column("row").to_pylist()
            for d, place, first, last, kmers in _wanted(part, data, offsets, spec, "places"):
                keys = ranges.of(_heads(data, place), kmers)
                for key, p, f, e in zip(keys.tolist(), place.tolist(), first.tolist(), last.tolist()):
                    held.append((key, raw[p : e + spec.length], raw[f:p], ids[d], p - int(offsets[d]), p - e))
                    size += e - f + spec.length
                if size > spec.run_bytes:
                    yield from flush(held)
                    held, size = [], 0
            yield from hot_windows(part, data, offsets, ids)
        yield from flush(held)

    def hot_windows(part, data, offsets, ids) -> Iterator[pa.RecordBatch]:
        """Windows of frequent k-mers, not sorted: hashes, texts and begins under range -1."""
        for d, _, first, last, _ in _wanted(part, data, offsets, spec, "hot"):
            begin = int(offsets[d])
            starts = np.concatenate([np.arange(f, e + 1) for f, e in zip(first, last)]) - begin
            hashes = _hashes(_prefix_hashes(data[begin : offsets[d + 1]]), starts, spec.length)
            row = {n: b"" for n in names} | {"shared": hashes.tobytes(), "rows": np.full(len(starts), ids[d]).tobytes(), "places": starts.tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *(pa.array([row[n]], pa.binary()) for n in names[1:])], names)

    return texts.select("row", "text", "places", "hot").mapInArrow(run, ", ".join(f"{n} {'long' if n == 'range' else 'binary'}" for n in names))


def _wanted(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, spec: Repeats, column: str):
    """Per text the listed anchors with their windows: text number, place, first and last start, k-mer."""
    found = [*anchors(data, offsets, spec)]
    if not found:
        return
    place, first, last, kmers = (np.concatenate([f[i] for f in found]) for i in range(4))
    owner = np.searchsorted(offsets, first, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(part) + 1))
    for d, listed in enumerate(part.column(column)):
        if listed.as_py():
            a, b = bounds[d], bounds[d + 1]
            use = np.isin(place[a:b] - offsets[d], listed.values.to_numpy())
            yield d, place[a:b][use], first[a:b][use], last[a:b][use], kmers[a:b][use]


def _merged_spans(columns: list[pa.Array], spec: Repeats):
    """Repeated spans ``row, begin, end`` of one key range."""
    runs, lefts, info = [], [], []
    for _, shared, sizes, rest, left_sizes, left, ids, places, spans in zip(*(c.to_pylist() for c in columns)):
        shared, sizes = np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(sizes, np.uint16).tolist()
        texts, before, at = [], b"", 0
        for n, size in zip(shared, sizes):
            before = before[:n] + rest[at : at + size]
            at += size
            texts.append(before)
        runs.append((texts, shared))
        ends = np.cumsum(np.frombuffer(left_sizes, np.uint16)).tolist()
        lefts.append([left[a:b] for a, b in zip([0, *ends], ends)])
        info.append((np.frombuffer(ids, np.int64), np.frombuffer(places, np.int64), np.frombuffer(spans, np.int16)))
    order, shared = merge_runs(runs)
    # neighbours without a common k-mer part the order into groups; groups of one have no repeat
    starts = np.flatnonzero(np.array(shared) < spec.kmer)
    bounds = np.append(starts, len(order))
    out, chunk = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            chunk += order[a:b]
            if len(chunk) >= 2048:
                out.append(_repeated(chunk, runs, lefts, info, spec))
                chunk = []
    if chunk:
        out.append(_repeated(chunk, runs, lefts, info, spec))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def _repeated(rows: list[tuple[int, int]], runs, lefts, info, spec: Repeats):
    reach = spec.length - spec.kmer
    total = reach + spec.length
    table = np.frombuffer(
        b"".join(lefts[r][i].rjust(reach, b"\0") + runs[r][0][i].ljust(spec.length, b"\0") for r, i in rows), np.uint8
    ).reshape(len(rows), total)
    low = np.array([info[r][2][i] for r, i in rows])
    high = np.array([len(lefts[r][i]) for r, i in rows])
    found = np.zeros((len(rows), reach + 3), bool)
    byte = lambda column: table[:, column].astype(np.uint64) + np.uint64(1)
    power = _tables(1 << 16)[0]
    rolled = np.zeros(len(rows), np.uint64)
    for i in range(spec.length):
        rolled += byte(reach + i) * power[i]
    for a in range(reach + 1):
        if a:  # one byte to the left
            rolled = byte(reach - a) + power[1] * (rolled - byte(reach - a + spec.length) * power[spec.length - 1])
        own = np.flatnonzero((low <= a) & (a <= high))
        if len(own) > 1:
            _, which, count = np.unique(mix64(rolled[own]), return_inverse=True, return_counts=True)
            found[own, a + 1] = count[which] > 1
    row, nearest = np.nonzero(found[:, 1:] & ~found[:, :-1])
    _, farthest = np.nonzero(found[:, :-1] & ~found[:, 1:])
    ids = np.array([info[r][0][i] for r, i in rows])[row]
    place = np.array([info[r][1][i] for r, i in rows])[row]
    return ids, place - (farthest - 1), place - nearest + spec.length


def _hot_spans(runs: DataFrame, spec: Repeats) -> DataFrame:
    """The same for k-mers too frequent for one range: windows are grouped by hash over all tasks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in zip(*(batch.column(c).to_pylist() for c in ("shared", "rows", "places"))):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in part], ["window", "row", "begin"])

    rows = runs.where("range < 0").mapInArrow(unpack, "window long, row long, begin long")
    often = materialise(rows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "often-windows")
    return rows.join(often, "window").select("row", "begin", (F.col("begin") + spec.length).alias("end"))


def _identified(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows with ``same``, a digest of the text by which texts are told apart, whatever their ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("same"), *columns)


def _here(left: str, right: str):
    """Rows with equal ids (or both without one) and equal texts."""
    return F.col(f"{left}doc_id").eqNullSafe(F.col(f"{right}doc_id")) & (F.col(f"{left}same") == F.col(f"{right}same"))


def repeated_spans(docs: DataFrame, spec: Repeats) -> DataFrame:
    """``_doc_id, _same, spans``: for every different pair of id and text that has some, its repeated spans as ``begin, end`` in bytes, unsorted.

    A text is searched once, through one of its rows; a text with copies is
    repeated as a whole.
    """
    docs = _identified(docs, "text")
    scanned = materialise(_scan(docs, spec).withColumn("row", F.monotonically_increasing_id()), "anchors")
    copies = scanned.groupBy("same").agg(
        F.min(F.struct("row", "doc_id")).alias("r"), F.count("*").alias("copies"), F.min("n_bytes").alias("n_bytes")
    )
    copies = materialise(copies.select("same", "r.row", "r.doc_id", "copies", "n_bytes"), "copies")
    several = copies.where((F.col("copies") > 1) & (F.col("n_bytes") >= spec.length)).select("same")
    every = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end"))).alias("spans")
    whole = scanned.join(several, "same").select("doc_id", "same", "n_bytes").distinct().select("doc_id", "same", every)
    places = scanned.join(copies.select("row"), "row", "left_semi")
    places = places.select("row", F.explode(F.arrays_zip("kmers", "heads", "places")).alias("x")).select("row", "x.*")
    # a table of its own: then both sides of the join are shuffled as they are, and AQE splits a very common k-mer
    often = materialise(places.groupBy("kmers").agg(F.count("*").alias("n")).where("n > 1"), "often")
    repeated = materialise(places.join(often, "kmers").select("row", "heads", "places", "n"), "repeated")
    hot = F.col("n") > spec.hot_rows
    n, any_hot = repeated.agg(F.count("*"), F.max(hot)).first()
    spans = whole
    if n:
        ranges = _ranges(repeated.where(~hot), n, spec)
        wanted = repeated.groupBy("row").agg(
            F.collect_list(F.when(~hot, F.col("places"))).alias("places"), F.collect_list(F.when(hot, F.col("places"))).alias("hot")
        )
        chosen = wanted.join(copies, "row").select("row", F.col("doc_id").alias("_doc_id"), F.col("same").alias("_same"), "places", "hot")
        texts = docs.join(chosen.hint("shuffle_hash"), _here("", "_")).select("row", "text", "places", "hot")
        if not scanned.groupBy("doc_id", "same").count().where("count > 1").isEmpty():
            # rows that repeat id and text would all stand for the text
            texts = texts.groupBy("row").agg(*(F.first(c).alias(c) for c in ("text", "places", "hot")))
        runs = _runs(texts, ranges, spec)
        runs = materialise(runs, "runs") if any_hot else runs
        found = by_key(runs.where("range >= 0"), "range", lambda c: _merged_spans(c, spec), "row long, begin long, end long")
        if any_hot:
            found = found.union(_hot_spans(runs, spec))
        # one row per text before the join; a text with copies is whole already, so no text is in both parts
        found = found.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
        spans = spans.unionByName(found.join(copies.where("copies = 1").select("row", "doc_id", "same"), "row").drop("row"))
    return spans.select(F.col("doc_id").alias("_doc_id"), F.col("same").alias("_same"), "spans")


def _removed(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    if spans is None:
        return []
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, min(b, size)) for a, b in out]


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for pair in gone for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def report(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row.

    A null or empty text has no bytes and keeps none. Texts shorter than a window
    lose nothing. Equal texts repeat each other in full. Rows without ``doc_id``,
    or with one that other rows have too, are searched and counted like all others.
    An empty table gives none; other columns are ignored.
    """
    rows = _identified(docs, "text").join(repeated_spans(docs, spec).hint("shuffle_hash"), _here("", "_"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for text, spans in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("spans").to_pylist()):
                text = text or b""
                gone = _removed(spans, len(text))
                out.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(text, gone)).hexdigest()))
            n, removed, number, sha = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, number)), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("doc_id", "text", "spans").mapInArrow(count, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:
    """The documents without their repeated passages; all rows and columns stay.

    A character that a cut leaves incomplete goes as well. ``n_chars``, if there
    is one, follows the text. A text that is repeated as a whole becomes empty;
    null stays null.
    """
    names = docs.columns
    spans = repeated_spans(docs, spec).select(F.col("_doc_id").alias("__r_doc_id"), F.col("_same").alias("__r_same"), F.col("spans").alias("__spans"))
    keys = _identified(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("r"), "doc_id", "text"), "r")
    rows = keys.select(F.col("doc_id").alias("__l_doc_id"), F.col("same").alias("__l_same"), "r").join(spans.hint("shuffle_hash"), _here("__l_", "__r_"), "left")
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = []
            for text, spans in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("__spans").to_pylist()):
                texts.append(None if text is None else _kept(text, _removed(spans, len(text))).decode(errors="ignore"))
            columns = part.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(*(F.col("r").getField(c).alias(c) for c in names), "__spans").mapInArrow(cut, docs.schema)
