import numpy as np
import pytest

from checks import fixtures, queries as q
from kindred.operators.titles import unit_vectors_in_place


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    names = ["red oak", "blue oak", "red lamp oak", "blue"]
    part = [(i, n, "SMALL", "B", 50, 10.0 + i) for i, n in enumerate(names)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    lines = [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0), (2, 3, 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    # words by name: blue, lamp, oak, red; products 0 to 3 have images
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, -1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


PAIRS = [(0, 1), (1, 0), (0, 2), (2, 0), (1, 3), (3, 1)]


def unit(v):
    return np.array(v) / np.linalg.norm(v)


def titles_by_hand():
    blue, lamp, oak, red = np.log(4 / 2), np.log(4 / 1), np.log(4 / 3), np.log(4 / 2)
    b, l, o, r = blue * np.array([1, 0]), lamp * np.array([0, 1]), oak * np.array([1, 1]), red * np.array([1, -1])
    return [unit(v) for v in (r + o, b + o, r + l + o, b)]


def test_title_distances_of_pairs(spark, tables):
    got = {(r.skuX, r.skuY): r.distance for r in q.dist_title(spark, tables).collect()}
    t = titles_by_hand()
    assert got == {(f"S{x}", f"S{y}"): pytest.approx((1 - t[x] @ t[y]) / 2, abs=1e-6) for x, y in PAIRS}


@pytest.mark.parametrize("name", ["dist_title", "dist_product", "dist_combo"])
def test_no_word_made_vector_is_shuffled(spark, tables, name):
    plan = getattr(q, name)(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_pairs_without_image_go_before_the_vectors_are_joined(spark, tables):
    got = q.dist_image(spark, tables)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    i = [unit(v) for v in ([1, 0], [0, 1], [1, 1], [1, -1])]
    assert {(r.skuX, r.skuY): r.distance for r in got.collect()} == {
        (f"S{x}", f"S{y}"): pytest.approx(1 - i[x] @ i[y], abs=1e-6) for x, y in PAIRS
    }


def test_unit_vectors_in_place(spark):
    words = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 4.0]), ("b", [0.0, 5.0]), ("z", [0.0, 0.0])], "word string, vec array<double>")
    rows = [(1, ["a", "b", "?"], ["b"]), (2, ["?"], None), (3, ["a"] * 70_000 + ["b"], ["z"]), (4, [], ["a", "a"])]
    got = {r.n: (r.x, r.y) for r in unit_vectors_in_place(
        spark.createDataFrame(rows, "n int, x array<string>, y array<string>").coalesce(1), {"x": words, "y": words}).collect()}
    assert got[1] == (pytest.approx([0.6, 0.8]), pytest.approx([0.0, 1.0])) and got[2] == (None, None)
    assert got[3] == (pytest.approx(unit([210_000, 4]).tolist()), [0.0, 0.0]) and got[4] == (None, [1.0, 0.0])


def test_tasks_of_pairs_grow_with_the_lines(spark, tables, monkeypatch):
    expected = sorted(q.rule_ladder_distance(spark, tables).collect())
    monkeypatch.setattr(fixtures, "LINES_PER_TASK", 1)  # 5 lines: 5 tasks, more than the session's 4
    got = q.rule_ladder_distance(spark, tables)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") >= 6 and sorted(got.collect()) == expected
    assert {(r.skuX, r.skuY) for r in expected} == {(f"S{x}", f"S{y}") for x, y in PAIRS}
