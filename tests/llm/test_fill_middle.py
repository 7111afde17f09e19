import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import fill_middle as fm


def units(text, unit):
    """Begins of the units of a text, by a plain scan."""
    if unit == "char":
        return list(range(len(text)))
    lines = {0} | {i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)} if text else set()
    if unit == "line":
        return sorted(lines)
    return sorted(lines | {m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)})


def brute(doc, text, unit="char", seed=1, percent=90, spm=20):
    text = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    begins = [*units(text, unit), len(text)]
    n = len(begins) - 1
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    low, high = (0 if c == 0 else begins[c] for c in (low, high))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc, n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    if h[3] % 100 < spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(8)
    out = [(i, "".join(rng.choice("ab é漢🙂\n\t<SPM>.\r") for _ in range(rng.randint(0, 90)))) for i in range(300)]
    out += [(300, "é" * 70_000 + "\n"), (301, "x y " * 30_000), (302, None), (303, ""), (None, "no id"), (None, None), (304, "<P>"), (305, "a<S"), (306, ">b<"), (5, "again"), (5, "again")]
    return out + [(400 + i, "<<P<S<MM>>" * 3) for i in range(40)] + [(500 + i, "one") for i in range(40)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_a_plain_scan_and_restores(spark, unit):
    data = rows()
    df = spark.createDataFrame([(*r, 7, "clash", 1) for r in data], "doc_id long, text string, first int, form string, n int")
    out = fm.transform(df, seed=1 if unit == "char" else 5, unit=unit)
    back = [tuple(r) for r in out.withColumn("text", fm.restored(F.col("output"), F.col("form"))).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(*brute(i, t, unit, 1 if unit == "char" else 5), t or "") for i, t in data]
    assert sorted(back, key=key) == sorted(want, key=key)
    assert {r[2] for r in back} == {"plain", "psm", "spm"}


def test_empty_table_and_unknown_unit(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fm.transform(none).count() == 0
    with pytest.raises(ValueError):
        fm.transform(none, unit="page")


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 4, size).astype(np.uint8)
        matrix, at = fm.WaveletMatrix(values), np.arange(size + 1)
        for v in range(4):
            assert matrix.rank(v, at).tolist() == [int((values[:i] == v).sum()) for i in at]
        begins = np.flatnonzero(values >= 2)
        low, high = np.zeros(len(begins), np.int64), np.full(len(begins), size)
        assert matrix.locate((2, 3), np.arange(len(begins)), low, high).tolist() == begins.tolist()
