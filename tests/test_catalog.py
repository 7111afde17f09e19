import random
import statistics

import pytest
from pyspark.sql import functions as F

from kindred.operators import catalog as cat
from kindred.operators.ranking import geometric_cutoff, median, top_per_key


def products(spark, rows):
    return spark.createDataFrame(rows, "sku_id string, group_id string, category_id string, price_hint string")


ROWS = [
    ("b", "g1", "c1", "10"), ("a", "g1", "c1", None), ("c", "g2", "c1", "30.5"),
    ("d", None, "c2", "20"), ("e", None, None, None), ("f", "g3", "c2", "1"), ("g", "g3", "c2", "2"),
]


def test_groups_of_one_disappear(spark):
    got = cat.drop_singleton_groups(products(spark, ROWS)).select("sku_id", "group_id").collect()
    assert dict(map(tuple, got)) == {"a": "g1", "b": "g1", "c": None, "d": None, "e": None, "f": "g3", "g": "g3"}


def test_prices_are_filled_with_the_exact_median(spark):
    got = dict(cat.fill_median_price(products(spark, ROWS)).select("sku_id", "price_hint").collect())
    assert got["a"] == got["e"] == 10.0 and got["c"] == 30.5


def test_bad_price_fails(spark):
    with pytest.raises(Exception):
        cat.fill_median_price(products(spark, [("a", None, "c", "cheap")])).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001])
@pytest.mark.parametrize("accuracy", [100, 100_000])
def test_median(spark, n, accuracy):
    rng = random.Random(n)
    values = [float(rng.choice([1, 1, 1, 5, rng.random() * 9])) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    assert median(df, "x", accuracy).first()[0] == statistics.median(values)


@pytest.mark.parametrize("spread", [1, 40, 10**9])
def test_median_by_narrowing_brackets(spark, spread):
    """A bracket far above its bound is narrowed by its own rows; ties that fill it end the search."""
    rng = random.Random(spread)
    values = [float(rng.randrange(spread)) for _ in range(20_001)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    assert median(df, "x", accuracy=100, max_values=50).first()[0] == statistics.median(values)


def test_median_of_nothing(spark):
    assert median(spark.createDataFrame([(None,)], "x double"), "x").first()[0] is None


def test_roles(spark):
    df = cat.with_roles(cat.drop_singleton_groups(products(spark, ROWS)))
    got = {r.sku_id: (r.primary_sku_id, r.role) for r in df.collect()}
    assert got["a"] == ("a", "primary") and got["b"] == ("a", "secondary") and got["c"] == ("c", "ungrouped")
    assert {r.sku_id for r in cat.candidates(df).collect()} == {"a", "c", "d", "e", "f"}
    assert dict(map(tuple, cat.secondary_to_primary(df).collect())) == {"b": "a", "g": "f"}
    members = {tuple(r) for r in cat.group_members(cat.drop_singleton_groups(products(spark, ROWS))).collect()}
    assert members == {("a", "a"), ("a", "b"), ("f", "f"), ("f", "g")}


def test_category_sizes_skip_null(spark):
    assert dict(map(tuple, cat.category_sizes(products(spark, ROWS)).collect())) == {"c1": 3, "c2": 3}


def test_duplicates_are_reported(spark):
    df = products(spark, ROWS + ROWS[:1])
    with pytest.raises(ValueError, match="sku_id"):
        cat.require_unique(df, "sku_id")
    assert cat.require_unique(products(spark, ROWS), "sku_id").count() == len(ROWS)


def test_top_per_key_equals_a_plain_sort(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(20), f"y{i:04}") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, y string")
    got = top_per_key(df, "k", [F.desc("v"), F.col("y")], 25, salt_by="y", rank="r", salts=8)
    want = set()
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want |= {(*r, i + 1) for i, r in enumerate(ordered[:25])}
    assert {tuple(r) for r in got.select("k", "v", "y", "r").collect()} == want


def test_geometric_cutoff_is_exact():
    for ini in (0.5, 0.95):
        assert ini ** geometric_cutoff(ini) == 0.0
