import hashlib
import random
from collections import Counter

import pytest

from kindred.llm import suffix_dedup as sd


def brute(rows, length=200):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[p : p + length] for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    def text(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [text(n) for n in (199, 200, 201, 230, 500, 1500)]
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randint(0, 700)) + "".join(rng.choice(passages) + text(rng.randint(0, 90)) for _ in range(rng.randint(0, 3)))))
    rows += [(100, None), (101, ""), (102, "x" * 200), (103, "ab" * 400), (104, rows[7][1]), (105, rows[7][1]), (106, "short"), (107, "short")]
    rows.append((108, passages[4][:350]))
    return rows


@pytest.mark.parametrize("spec", [sd.Repeats(), sd.Repeats(range_rows=20, hot_rows=6, run_bytes=3000, segment=300)])
def test_equals_brute_force(spark, spec):
    rows = corpus()
    got = sd.report(spark.createDataFrame(rows, "doc_id long, text string"), spec).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows)


def test_ids_do_not_matter(spark):
    """Ids that repeat with other texts, null ids and repeated rows: every row is judged by its text."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = text(300), text(600)
    texts = [text(50) + passage, other, passage + text(20), text(500), "q" + passage + text(250), text(700), text(900), text(230), "tiny", None]
    ids = [1, 1, None, None, 2, 3, 3, 2, None, 1]
    rows = [*zip(ids, texts), (5, texts[5]), (3, texts[5]), (7, texts[6]), (7, texts[6]), (None, texts[7]), (None, texts[7]), (None, None)]
    numbered = brute(list(enumerate(t for _, t in rows)))
    want = Counter((i, *numbered[n]) for n, (i, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for spec in (sd.Repeats(), sd.Repeats(range_rows=5, hot_rows=4)):
        assert Counter(tuple(r) for r in sd.report(df, spec).collect()) == want
        cut = sd.cut_repeats(df, spec).collect()
        kept = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut)
        assert kept == Counter((i, numbered[n][3]) for n, (i, _) in enumerate(rows))


def test_overfull_heads_are_parted(spark):
    """Many k-mers with the same first bytes: no range holds them all, and the result is the same."""
    import numpy as np

    rng = random.Random(4)
    body = lambda: "".join(rng.choice("abcdefgh") for _ in range(260))
    shared = [" " * 40 + body() for _ in range(30)]
    rows = [(i, body() + shared[i % 30] + body()) for i in range(90)]
    spec = sd.Repeats(range_rows=10, hot_rows=1000)
    got = sd.report(spark.createDataFrame(rows, "doc_id long, text string"), spec).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows)
    ranges = sd.Ranges(np.array([5, 9]), np.array([7]), np.array([3]))
    of = ranges.of(np.array([4, 5, 9, 7, 7, 7, 7, 8]), np.arange(8).astype(np.uint64))
    assert of[:3].tolist() == [0, 1, 2] and set(of[3:7].tolist()) <= {3, 4, 5} and of[7] == 1


def test_cut_keeps_rows_and_columns(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(400))
    df = spark.createDataFrame([(1, "z" + long, "s", 401), (2, "é" + long, None, 401), (3, None, "x", 0), (None, long, "y", 400)], "doc_id long, text string, spans string, n_chars int")
    out = sd.cut_repeats(df)
    assert out.schema == df.schema
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.collect() if r.doc_id) == [(1, "z", 1), (2, "é", 1), (3, None, None)]
    assert sd.report(df.limit(0)).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    for n in (1, 2, 3, 7):
        runs = []
        for _ in range(n):
            texts = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 40)))
            runs.append((texts, sd.front_code(texts)[0]))
        order, shared = sd.merge_runs(runs)
        merged = [runs[r][0][i] for r, i in order]
        assert merged == sorted(t for r in runs for t in r[0])
        assert shared == sd.front_code(merged)[0]


def test_spans_are_gathered_per_text_before_they_meet_the_texts(spark, capsys):
    """A passage that every text has gives many spans: one row per text, not one per span, is joined."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, f"{i} " + passage + f" {i * 7919}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sd.repeated_spans(df, sd.Repeats())
    spans.explain()
    plan = capsys.readouterr().out
    assert "keys=[row#" in plan and "keys=[_doc_id#" not in plan
    assert spans.count() == 40
    assert {r[0]: tuple(r[1:]) for r in sd.report(df).collect()} == brute(rows)


def test_a_long_text_is_scanned_in_small_segments():
    import tracemalloc

    import numpy as np

    data = np.random.default_rng(3).integers(32, 127, 1 << 20).astype(np.uint8)
    tracemalloc.start()
    found = sum(len(part[0]) for part in sd.anchors(data, np.array([0, len(data)]), sd.Repeats()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > len(data) // 200 and peak < 30 << 20
