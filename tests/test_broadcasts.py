from pyspark.sql import functions as F

from kindred.functions.distance import Weights
from kindred.operators import coview as cv
from kindred.operators.catalog import with_roles
from kindred.plans.recommend import Model, select_products, with_features


def test_tables_that_grow_with_the_catalog_are_not_sent_through_the_driver(spark, capsys, monkeypatch):
    """Equal titles: on disk the vectors are next to nothing, in memory they are what they are."""
    n = 3000
    catalog = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("S"), "id").alias("sku_id"), F.lit(None).cast("string").alias("group_id"),
        F.lit("c").alias("category_id"), F.lit("red lamp").alias("title"), F.lit("b").alias("brand"), F.lit(1.0).alias("price_hint"), F.lit("lamp").alias("products"),
    )
    words = spark.createDataFrame([("red", [1.0, 0.5] * 32), ("lamp", [0.25, 1.0] * 32)], "word string, vec array<double>")
    plans = []

    def watched(df, name="table"):
        df.explain()
        plans.append(capsys.readouterr().out)
        return df

    monkeypatch.setattr(cv, "materialise", watched)
    model = Model(weights=Weights(title=1.0, image=0.0, product=1.0))
    featured = with_features(select_products(catalog, model, words), model, words)
    featured.explain()
    plans.append(capsys.readouterr().out)
    roles = with_roles(featured)
    pairs = spark.range(20).select(F.concat(F.lit("S"), "id").alias("skuX"), F.concat(F.lit("S"), F.col("id") + 1).alias("skuY"), F.lit(1.0).alias("ggXY"))
    best = cv.best_coview(pairs, roles.select("sku_id", "primary_sku_id"))
    best.explain()
    plans.append(capsys.readouterr().out)
    ranks = cv.candidate_ranks(roles, cv.coview_weights(best), model.weights)
    for plan in plans:
        for key in ("[id#", "[sku_id#", "[skuX#", "[skuY#", "[x#", "[y#"):
            assert f"BroadcastHashJoin {key}" not in plan
    assert any("SortMergeJoin [id#" in plan for plan in plans)
    assert {(r.x, r.y) for r in ranks.collect()} == {(f"S{i}", f"S{i + 1}") for i in range(20)}
