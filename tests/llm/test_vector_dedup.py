import math
from collections import Counter

import numpy as np
import pytest

from kindred.llm import vector_dedup as vd


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        base = rng.normal(size=16)
        rows += [base + rng.normal(size=16) * 0.08 * np.linalg.norm(base) / 4 for _ in range(rng.choice([1, 1, 2, 9, 30]))]
    rows += [rows[3], rows[3] * 2, rows[3]]
    return [(i, [float(v) for v in r]) for i, r in enumerate(rows)]


def brute(rows):
    x = np.array([r for _, r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    return {rows[i][0]: (int(near[i].sum()), rows[label[i]][0]) for i in range(len(x))}


@pytest.mark.parametrize("spec", [vd.Range(), vd.Range(cell=60, block=40, cluster=20)])
def test_equals_brute_force(spark, spec):
    rows = vectors()
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [math.nan] * 16), (9003, [1.0] * 15 + [None]), (9004, [1.0, 2.0]), (9005, [2.0, 4.0]), (9006, []), (9007, [math.inf] * 16)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, unit string, copies int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vd.dedup(df, spec).collect()}
    want = brute(rows) | {i: (0, i) for i, _ in odd} | {9004: (1, 9004), 9005: (1, 9004)}
    assert len(got) == len(want)
    found, true = sum(got[i][0] for i in want), sum(n for n, _ in want.values())
    assert found >= 0.98 * true and all(got[i][0] <= want[i][0] for i in want)
    assert Counter(got[i][1] == want[i][1] for i in want)[True] >= 0.98 * len(want)


@pytest.mark.parametrize("clumps, size", [(5, 60), (30, 55)])
def test_links_between_large_clumps(spark, clumps, size):
    rng = np.random.default_rng(7)
    centres = np.sqrt(0.96) * np.eye(40)[0] + np.sqrt(0.04) * np.eye(40)[1 : clumps + 1]
    x = np.repeat(centres, size, 0)[rng.permutation(clumps * size)] + rng.normal(size=(clumps * size, 40)) * 1e-4
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spec = vd.Range(cell=2_000, block=2_000, overlaps=(2,))
    assert {r.vec_id: (r.n_links, r.component_id) for r in vd.dedup(df, spec).collect()} == brute(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    adjacent, medoids = vd.flat_graph(unit, vd.Range())
    found = vd.search(unit, adjacent, medoids, np.arange(len(x)), vd.Range())
    assert (found.sum(1) == len(x) - 1).all()


def test_short_or_unmeasured_recall_ends_in_exact_links(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    short = vd.Range(cell=20, block=15, cluster=10, overlaps=(1,), recall=1.1)
    assert {r.vec_id: (r.n_links, r.component_id) for r in vd.dedup(df, short).collect()} == brute(rows)
    # the search finds nothing and the audited vectors have no link
    rng = np.random.default_rng(4)
    lone = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(3_000, 24)))]
    lone[2_999] = (2_999, [v + 0.01 for v in lone[1][1]])
    df = spark.createDataFrame(lone, "vec_id long, embedding array<double>")
    monkeypatch.setattr(vd, "audit", lambda *_: (0, 0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vd.dedup(df, vd.Range(cell=100, overlaps=(1,))).collect()}
    assert got == brute(lone) and got[2_999] == (1, 1)


def test_audit_draws_linked_vectors(spark):
    lone = np.eye(300)
    lone[299] = lone[298] + 0.01 * lone[0]
    reps = vd.unit_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(lone)], "vec_id long, embedding array<double>")).selectExpr("*", "1L as copies")
    counts = spark.createDataFrame([(298, 1), (299, 1)], "vec_id long, found long")
    assert vd.audit(reps, counts, vd.Range(audited=4)) == (2, 2)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (0, [2.0, 0.0])], schema)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vd.dedup(df).collect())
    assert got == [(False, 0, 2, 0, True), (False, 1, 2, 0, False), (False, 1, 2, 0, False), (True, 0, 0, None, True)]
    assert vd.dedup(df.limit(0)).count() == 0
