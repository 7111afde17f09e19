import pytest

from checks import fixtures as fx
from checks.compare import difference, oracle
from checks.queries import REGISTRY
from kindred.functions.distance import Weights
from kindred.plans.recommend import Model, recommend

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "price_median_fill", "group_roles", "catalog_json", "clean_documents", "title_tokens", "tfidf_terms_smooth",
    "title_tfidf_vec", "product_vec", "dist_combo", "topk_recommend", "topk_many_tiles", "coview_weights",
    "coview_eval_per_query",
]


@pytest.fixture(scope="module")
def db():
    return oracle(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    assert difference(spark, db, SF, name) is None


def test_names_are_valid():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries()) >= set(REGISTRY)


def test_image_weight_zero_keeps_products_without_image(spark):
    words, raw = fx.words(spark, SF), fx.catalog(spark, SF)
    images = fx.images(spark, SF).where("id < '3'")
    with_images = recommend(raw, Model(), words=words, images=images)[1]
    without = recommend(raw, Model(weights=Weights(1, 0)), words=words)[1]
    assert with_images.count() < without.count() == raw.count()


def test_missing_inputs_are_named(spark):
    raw = fx.catalog(spark, SF)
    with pytest.raises(ValueError, match="words"):
        recommend(raw, Model())
    with pytest.raises(ValueError, match="unknown method"):
        recommend(raw, Model(method="bm25"))
    with pytest.raises(ValueError, match="document_vectors"):
        recommend(raw, Model(weights=Weights(1, 0), method="dm"))
