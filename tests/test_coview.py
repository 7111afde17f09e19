import random

import numpy as np
import pytest

from kindred.functions.distance import Weights
from kindred.operators import coview as cv
from kindred.operators.catalog import with_roles
from kindred.sources.readers import coview_pairs

PRODUCTS = "sku_id string, group_id string, category_id string, title_vec array<double>"
PAIRS = "skuX string, skuY string, ggXY double"


def angle(degrees):
    return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]


def test_worked_example(spark):
    rows = [("q", None, "c", angle(0)), ("y2", None, "c", angle(10)), ("z", None, "c", angle(20)),
            ("y1", None, "c", angle(30)), ("y3", None, "d", angle(0))]
    products = with_roles(spark.createDataFrame(rows, PRODUCTS))
    pairs = spark.createDataFrame([("q", "y1", 10.0), ("q", "y2", 5.0), ("q", "y3", 2.0), ("q", "y2", None), ("q", "?", 9.0)], PAIRS)
    weighted = cv.coview_weights(cv.best_coview(pairs, products))
    ranks = cv.candidate_ranks(products, weighted, Weights(1, 0))
    sums = cv.score_per_query(weighted, ranks).collect()
    assert [tuple(r) for r in sums] == [("q", pytest.approx(1.759875), pytest.approx(1.9025))]
    ratio = cv.coview_ratio(cv.score_per_query(weighted, ranks)).first()[0]
    assert ratio == pytest.approx(0.92503, abs=1e-5)
    alone = cv.candidate_ranks(products, weighted, Weights(1, 0), exclude_self=True)
    assert {(r.y, r.rank0) for r in alone.collect()} == {("y2", 0), ("y1", 2)}


def test_rank_by_second_character(spark):
    best = spark.createDataFrame([("q", "a1", 9.0), ("q", "b3", 1.0), ("q", "c2", 5.0)], "x string, y string, score double")
    got = {r.y: r.w_y for r in cv.coview_weights(best, rank_by="id_char2").collect()}
    assert got == {"b3": 1.0, "c2": 0.95, "a1": pytest.approx(0.9025)}
    with pytest.raises(ValueError):
        cv.coview_weights(best, rank_by="name")


def test_node_prefix(spark):
    rows = [("a", "b", "180001", "180001", 1.0), ("a", "c", "180001", "180002", 1.0), ("a", "d", "17", "17", 1.0)]
    df = spark.createDataFrame(rows, "skuX string, skuY string, nodeX string, nodeY string, ggXY double")
    assert [tuple(r) for r in coview_pairs(df, "18000").collect()] == [("b", "a", 1.0)]


@pytest.mark.parametrize("tile_rows", [None, 30])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_equals_brute_force(spark, tile_rows, exclude_self):
    rng = random.Random(4)
    rows = [
        (f"s{i:03}", rng.choice([None, f"g{rng.randrange(40)}"]), "hot" if rng.random() < 0.7 else "c",
         angle(rng.randrange(0, 90, 10)))
        for i in range(200)
    ]
    pairs = [(f"s{0 if rng.random() < 0.3 else rng.randrange(200):03}", f"s{rng.randrange(210):03}", float(rng.randrange(9)))
             for _ in range(600)]
    primary, first = {}, {}
    for s, g, _, _ in sorted(rows):
        primary[s] = first.setdefault(g, s) if g else s
    info = {r[0]: r for r in rows}
    score = {}
    for x, y, v in pairs:
        if x in info and y in info:
            at = score.setdefault(x, {})
            at[primary[y]] = max(v, at.get(primary[y], -1))
    want = {}
    for x, ys in score.items():
        order = sorted(ys, key=lambda y: (-ys[y], y))
        weight = {y: 0.95**i for i, y in enumerate(order)}
        block = [c for c in rows if c[2] == info[x][2] and primary[c[0]] == c[0] and not (exclude_self and c[0] == x)]
        ranked = sorted(block, key=lambda c: (round(0.5 * (1 - np.dot(c[3], info[x][3])), 6), c[0]))
        place = {c[0]: i for i, c in enumerate(ranked)}
        hit = [y for y in order if y in place]
        want[x] = (sum(weight[y] * 0.95 ** place[y] for y in hit), sum(weight[y] ** 2 for y in hit))

    products = with_roles(spark.createDataFrame(rows, PRODUCTS))
    weighted = cv.coview_weights(cv.best_coview(spark.createDataFrame(pairs, PAIRS), products))
    ranks = cv.candidate_ranks(products, weighted, Weights(1, 0), 6, exclude_self=exclude_self, tile_rows=tile_rows)
    got = {r.x: (r.weight_sum, r.full_sum) for r in cv.score_per_query(weighted, ranks).collect()}
    assert got.keys() == want.keys()
    for x in want:
        assert got[x] == pytest.approx(want[x])


def test_rank_at_a_rounding_edge(spark):
    rows = [("a", "c", 999997.5, angle(0)), ("b", "c", 1000002.5, angle(0))]
    products = with_roles(spark.createDataFrame([(s, None, c, p, v) for s, c, p, v in rows],
                                                "sku_id string, group_id string, category_id string, price_hint double, title_vec array<double>"))
    weighted = spark.createDataFrame([("b", "a", 1.0)], "x string, y string, w_y double")
    got = cv.candidate_ranks(products, weighted, Weights(0, 0, price=1), 6, exclude_self=True).collect()
    assert [(r.x, r.y, r.rank0) for r in got] == [("b", "a", 0)]
