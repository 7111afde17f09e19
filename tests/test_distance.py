import pytest
from pyspark.sql import functions as F

from kindred.functions import distance as d
from kindred.functions.vectors import hashed_vector, l2_normalize


@pytest.mark.parametrize(
    "candidate,query,want",
    [
        (100.0, 100.0, 0.0), (100.0, 110.0, 0.0), (100.0, 50.0, 50 / 150), (100.0, 120.0, 10 / 220),
        (0.0, 0.0, 0.0), (5.0, -5.0, 0.0), (None, 3.0, 0.0), (float("nan"), 3.0, 0.0),
    ],
)
def test_price(spark, candidate, query, want):
    df = spark.createDataFrame([(candidate, query)], "a double, b double")
    assert df.select(d.price_distance(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_brand(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("x", None), (None, None)], "a string, b string")
    plain = [r[0] for r in df.select(d.brand_distance(F.col("a"), F.col("b"))).collect()]
    safe = [r[0] for r in df.select(d.brand_distance(F.col("a"), F.col("b"), True)).collect()]
    assert plain == [0.0, 1.0, 1.0, 1.0] and safe == [0.0, 1.0, 1.0, 0.0]


def test_blend_and_gating(spark):
    row = [([1.0, 0.0], [0.6, 0.8], "x", 10.0), ([0.0, 1.0], [1.0, 0.0], "y", 5.0)]
    schema = "title_vec array<double>, image_vec array<double>, brand string, price_hint double"
    a, b = (spark.createDataFrame([r], schema).select(F.struct("*").alias(n)) for r, n in zip(row, "ab"))
    df = a.join(b, F.lit(True))
    dist = lambda w: df.select(
        d.blended_distance(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), w)
    ).first()[0]
    assert dist({"title_wt": 0.85, "image_wt": 0.15, "prod_wt": 0, "brand_wt": 0, "price_wt": 0}) == pytest.approx(
        0.85 * 0.5 + 0.15 * 0.4
    )
    assert dist(d.Weights(1, 0, 0, 2, 3)) == pytest.approx(0.5 + 2 + 3 * 5 / 15)
    assert d.Weights(1, 0).columns() == ["title_vec"]
    with pytest.raises(TypeError):
        d.Weights.of({"colour": 1})


def test_rule_ladder(spark):
    rows = [
        (None, None, "a", None, 0.8), ("sofa", None, "sofa", None, 0.0), ("sofa", None, "bed", "sofa", 0.1),
        ("bed", "sofa", "sofa bed", "x", 0.3), ("sofa", None, "sofa bed", None, 0.3), ("a", None, "b", None, 1.0),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "a string, ap string, b string, bp string")
    got = [r[0] for r in df.select(d.product_rule_distance(*map(F.col, ("a", "ap", "b", "bp")))).collect()]
    assert got == [r[4] for r in rows]


def test_normalise_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_hashed_vector_is_repeatable_and_bounded(spark):
    df = spark.range(50).select(hashed_vector(F.col("id"), 16).alias("v"))
    first, again = df.collect(), df.repartition(3).orderBy("v").collect()
    assert sorted(r.v for r in first) == [r.v for r in again]
    flat = [x for r in first for x in r.v]
    assert -0.25 <= min(flat) < -0.2 and 0.2 < max(flat) <= 0.25
