"""Fill-in-middle: texts cut at random units, found in a wavelet matrix of character classes.

Every byte of a text has a class: it continues a character, or it begins a
character, a word or a line. A wavelet matrix over these classes answers how many
bytes of a class lie before a place (rank). The sums of such ranks count the
boundaries of a unit: lines alone, lines and words, or all characters. As these
counts rise with the place, the place of the k-th boundary is found by bisection
on them. One matrix serves all texts of a batch, and both cuts of all of them are
bisected together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SPACE, slices, text_bytes

#: Classes of bytes: a byte inside a character, a character inside a word, the begin of a word, the begin of a line.
INSIDE, CHARACTER, WORD, LINE = range(4)
#: The classes at which each unit begins.
UNITS = {"char": (CHARACTER, WORD, LINE), "word": (WORD, LINE), "line": (LINE,)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Bits:
    """A row of bits with counts of ones per 64, so that ranks cost one look-up and one popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one row of bits per binary digit.

    The highest digit comes first; from row to row the numbers with digit 0 move
    to the front, in their order.
    """

    def __init__(self, values: np.ndarray, digits: int = 2):
        self.size, self.rows, self.zeros = len(values), [], []
        for digit in reversed(range(digits)):
            ones = (values >> digit & 1).astype(bool)
            self.rows.append(Bits(ones))
            self.zeros.append(int(len(ones) - np.count_nonzero(ones)))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each place."""
        begin, end = np.zeros(1, np.int64), at
        for digit, (bits, zeros) in enumerate(zip(self.rows, self.zeros)):
            if value >> (len(self.rows) - 1 - digit) & 1:
                begin, end = zeros + bits.rank(begin), zeros + bits.rank(end)
            else:
                begin, end = begin - bits.rank(begin), end - bits.rank(end)
        return end - begin

    def count(self, values: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of several values occur before each place."""
        return sum(self.rank(value, at) for value in values)

    def locate(self, values: tuple[int, ...], many: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place in ``low`` to ``high`` of the occurrence before which there are ``many``; ``high`` if there is none.

        That is the last place with no more than ``many`` before it, up to ``high``.
        """
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.count(values, middle) <= many
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte of texts in UTF-8. A text begins a line and, but for white space, a word."""
    inside = (data & 0xC0) == 0x80
    out = np.where(inside, INSIDE, CHARACTER).astype(np.uint8)
    if not len(data):
        return out
    space, fresh = SPACE[data], np.zeros(len(data), bool)
    fresh[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    out[1:][space[:-1] & ~space[1:]] = WORD
    out[fresh] = LINE
    out[1:][data[:-1] == 0x0A] = LINE
    return out


def _group(seed: str, doc_id: Column, number: int) -> Column:
    """The number in one of the groups of eight digits of a document's hash."""
    digits = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * number + 1, 8), 16, 10).cast("long")


def _cutting(unit: str):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    mark = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            matrix = WaveletMatrix(classes(data, offsets))
            begin, end = offsets[:-1], offsets[1:]
            start = matrix.count(UNITS[unit], begin)
            n = matrix.count(UNITS[unit], end) - start
            chosen = [part.column(c).to_numpy() % (n + 1) for c in ("first", "second")]
            # a cut after all units is the end of the text; before the first one its begin
            places = [
                np.where(c == 0, begin, np.where(c == n, end, matrix.locate(UNITS[unit], start + c, begin, end)))
                for c in (np.minimum(*chosen), np.maximum(*chosen))
            ]
            chars = [matrix.count(UNITS["char"], p) for p in (begin, *places)]
            forms, outputs = part.column("form").to_pylist(), []
            raw = data.tobytes()
            for a, b, p, m, form in zip(begin.tolist(), end.tolist(), places[0].tolist(), places[1].tolist(), forms):
                if form == "psm":
                    outputs.append(b"".join((mark[0], raw[a:p], mark[1], raw[m:b], mark[2], raw[p:m])))
                elif form == "spm":
                    outputs.append(b"".join((mark[1], raw[m:b], mark[0], raw[a:p], mark[2], raw[p:m])))
                else:
                    outputs.append(raw[a:b])
            plain = np.array([f == "plain" for f in forms], bool)
            sizes = [pa.array(chars[i + 1] - chars[i], mask=plain) for i in (0, 1)]
            columns = [part.column("doc_id"), pa.array(n), part.column("form"), *sizes, pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def transform(docs: DataFrame, seed: int = 1, unit: str = "char", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row, over its whole text.

    ``n`` counts the units of the text: ``char`` (code points), ``word`` (each with
    the white space behind it) or ``line``. The hash of ``seed:doc_id`` chooses two
    cuts from 0 to ``n``, the form (``percent`` of the documents are cut, and of
    these ``spm_percent`` have the suffix first) and nothing else does, so equal
    ids are cut alike and reruns agree. A text that is empty or holds one of the
    marks stays ``plain``, with null lengths. With words, white space before the
    first one belongs to no word: a text begins with a unit anyway.

    A null text counts as empty, a null id as no digits. Rows that repeat are each
    transformed. An empty table gives none; other columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(mark))
    doc_id = F.col("doc_id").cast("long")
    first, second, third, fourth = (_group(f"{seed}:", doc_id, i) for i in range(4))
    form = F.when((text == "") | marked | (third % 100 >= percent), "plain").when(fourth % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), first.alias("first"), second.alias("second"), form.alias("form"))
    return rows.mapInArrow(_cutting(unit), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of.

    The parts hold no mark, and none can arise where a part and a mark meet, as
    every mark begins with a character that occurs in it once.
    """
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.length(one) + F.lit(len(PREFIX) + 1))
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + F.lit(len(MIDDLE) + 1))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
