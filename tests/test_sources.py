import json

import pytest

from kindred.sources import readers, sinks

RECORDS = [
    {"id": "1", "sku_id": "S1", "group_id": "g", "category_id": 180001, "title": "Bed", "brand": "x", "price_hint": "9.5",
     "extra": 1, "main_image": {"raw": "u1"},
     "elasticsearch_result": {"products": {"sofa": 1, "bed": {"n": 2}, "frame": 3}, "parentProducts": {"bed": 1}}},
    {"id": "2", "sku_id": "S2", "category_id": 180001, "title": "Sofa", "price_hint": 7, "main_image": {"raw": None},
     "elasticsearch_result": {"products": {"sofa": 1, "chair": 1}, "parentProducts": {}}},
    {"id": "3", "sku_id": "S3", "category_id": 180002, "title": "?", "main_image": {"raw": "u3"},
     "elasticsearch_result": {"products": {}, "parentProducts": {}}},
    {"id": "4", "sku_id": "S4", "category_id": 180002, "title": "Only parent", "main_image": {"raw": "u4"},
     "elasticsearch_result": {"products": {"bed": 1}, "parentProducts": {"bed": 1}}},
]


def test_catalog_of_array_files(spark, tmp_path):
    (tmp_path / "180001.json").write_text(json.dumps(RECORDS[:2]))
    (tmp_path / "180002.json").write_text(json.dumps(RECORDS[2:], indent=1))
    (tmp_path / "99.json").write_text(json.dumps(RECORDS))
    got = {r.id: r for r in readers.read_catalog(spark, f"{tmp_path}/18000*.json").collect()}
    assert len(got) == 4 and len(got["1"]) == 10
    assert (got["1"].products, got["1"].parentProducts, got["1"].image_url) == ("frame and sofa", "bed", "u1")
    assert (got["2"].products, got["2"].parentProducts, got["2"].price_hint) == ("chair and sofa", None, "7")
    assert (got["3"].products, got["3"].parentProducts) == (None, None)
    assert (got["4"].products, got["4"].parentProducts) == ("", "bed")


def test_image_vectors(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 7, "prelogits": [1, 2.5], "more": 0}]))
    assert [tuple(r) for r in readers.read_image_vectors(spark, str(tmp_path)).collect()] == [("7", [1.0, 2.5])]


def test_word_vectors_with_header(spark, tmp_path):
    (tmp_path / "w.vec").write_text("2 3\nsofa 1 2 3 \nbed -1 0.5 1e-3\n")
    got = dict(readers.read_word_vectors(spark, str(tmp_path / "w.vec")).collect())
    assert got == {"sofa": [1.0, 2.0, 3.0], "bed": [-1.0, 0.5, 0.001]}


def test_name_map_last_line_wins(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a => b\nc=>d => e\n a =>  z \n")
    assert dict(readers.read_name_map(spark, str(tmp_path / "m.txt")).collect()) == {"a": "z", "c": "d"}
    (tmp_path / "bad.txt").write_text("nothing here\n")
    with pytest.raises(Exception, match="=>"):
        readers.read_name_map(spark, str(tmp_path / "bad.txt")).collect()


def test_corpus_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a  b\n\n c d\te\n")
    rows = readers.read_corpus(spark, str(tmp_path / "c.txt")).collect()
    assert [r.tokens for r in rows] == [["a", "b"], [], ["c", "d", "e"]]
    assert len({r.doc for r in rows}) == 3


def test_recommendations_show_missing_neighbours(spark, tmp_path):
    df = spark.createDataFrame([("1", "2", 0.5, "lsa"), ("3", None, None, "lsa")], "idX string, idY string, score double, method string")
    sinks.write_recommendations(df, f"{tmp_path}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(lines, key=lambda r: r["idX"]) == [
        {"idX": "1", "idY": "2", "score": 0.5, "method": "lsa"},
        {"idX": "3", "idY": "N/A", "score": "N/A", "method": "lsa"},
    ]
    sinks.write_recommendations(df, f"{tmp_path}/parquet", "parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 2


def test_catalog_export(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "u", "t", "c", 5)], "id string, brand string, image_url string, title string, category_id string, x int")
    sinks.write_catalog_export(df, f"{tmp_path}/e")
    line = json.loads(spark.read.text(f"{tmp_path}/e").first().value)
    assert line == {"id": "1", "brand": None, "image_url": "u", "title": "t", "node_id": "c"}
