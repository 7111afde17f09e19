"""URL filters: all glob rules run at once over each URL by a bit-parallel automaton.

A rule is a glob over the canonical form ``.host/path``: ``*`` stands for any
bytes but ``/``, ``**`` for any bytes, ``?`` for one character. Each pattern has
a start bit and one bit per symbol; the bits of all patterns are packed into
64-bit words. For a byte ``c`` the next state is
``((state << 1) & step[c]) | (state & stay[c])``, with the carry between words;
``stay`` holds the states on which a wildcard loops. A batch of URLs advances
together, one byte at a time, in order of length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices, text_bytes

CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True


@dataclass(frozen=True)
class Rule:
    """``name`` is reported if ``listed``; the rule with the highest ``rank`` decides, a block before an allow."""

    glob: str
    verdict: str
    name: str
    rank: int
    listed: bool = True


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix. Longer rules win."""
    return Rule(f"*.{_plain(host)}{_plain(path)}**", verdict, host + path, 1000 + len(host + path))


def _plain(text: str) -> str:
    return text.replace("\\", "\\\\").replace("*", "\\*").replace("?", "\\?")


SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
#: What no site rule decides: files that are no web pages, and pages behind a form.
GENERAL_RULES = tuple(
    Rule(glob, "block", glob, 1, listed=False)
    for glob in (
        *(f"**/**.{end}" for end in ("exe", "zip", "gz", "iso", "mp3", "mp4", "jpg", "jpeg", "png", "gif", "css", "js")),
        *(f"**/{page}" for page in ("login", "signin", "logout", "cart", "checkout")),
        "*.adserver.*/**",
        ".ads.*/**",
    )
)


class Automaton:
    """Masks of all patterns. Size: one bit per pattern symbol and start, in every one of 256 rows."""

    def __init__(self, globs: Sequence[str]):
        bits: list[tuple[np.ndarray, np.ndarray]] = []
        starts, finals = [], []
        for glob in globs:
            starts.append(len(bits))
            bits.append((np.zeros(256, bool), np.zeros(256, bool)))
            data, i = glob.encode(), 0
            while i < len(data):
                symbol = data[i : i + 1]
                if symbol == b"*":
                    wide = data[i : i + 2] == b"**"
                    loops = bits[-1][1]
                    loops[:] = [True if wide or c != ord("/") else loops[c] for c in range(256)]
                    i += 1 + wide
                    continue
                step, stay = np.zeros(256, bool), np.zeros(256, bool)
                if symbol == b"?":
                    step |= ~CONTINUATION
                    stay |= CONTINUATION
                else:
                    i += symbol == b"\\"
                    step[data[i]] = True
                bits.append((step, stay))
                i += 1
            finals.append(len(bits) - 1)
        self.words = -(-len(bits) // 64)
        self.step = self._pack([b[0] for b in bits])
        self.stay = self._pack([b[1] for b in bits])
        self.start = self._set(starts)
        self.final = [(f // 64, np.uint64(f % 64)) for f in finals]

    def _pack(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for i, row in enumerate(rows):
            out[row, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def _set(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in places:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which pattern fits which text, as a boolean matrix."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.start, (len(sizes), 1))
        ends = np.cumsum(np.bincount(sizes, minlength=1)[::-1])[::-1] if len(sizes) else np.zeros(1, int)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(sizes.max(initial=0))):
            live = order[: ends[i + 1]]
            now = state[live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            c = data[offsets[live] + i]
            state[live] = (moved & self.step[c]) | (now & self.stay[c])
        return np.stack([(state[:, w] >> b & one).astype(bool) for w, b in self.final], 1) if self.final else np.zeros((len(sizes), 0), bool)


def host_of(url: Column) -> Column:
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = (*SITE_RULES, *GENERAL_RULES), default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row.

    A null URL or one without ``://`` has an empty host and path and gets the
    default verdict; so do texts of any length that no rule fits. Equal rows get
    equal results; an empty table gives none; other columns are ignored.
    """
    automaton = Automaton([r.glob for r in rules])
    # of several rules that fit, the one that comes last here decides
    order = sorted(range(len(rules)), key=lambda i: (rules[i].rank, rules[i].verdict == "block"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "canonical"):
            fits = automaton.run(*text_bytes(part.column("canonical")))
            best = np.full(len(part), -1)
            for i in order:
                best[fits[:, i]] = i
            names = [rules[i].name if i >= 0 and rules[i].listed else None for i in best]
            verdicts = [rules[i].verdict if i >= 0 else default for i in best]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("page_id", "host", "path")), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    parts = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("canonical", F.concat(F.lit("."), "host", "path")).mapInArrow(
        judge, "page_id long, host string, path string, rule string, verdict string"
    )
