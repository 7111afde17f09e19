import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.fixtures import texts
from kindred.operators import lsa, terms, titles
from kindred.operators.quality import weighted_document_vectors

WORDS = [("sofa", [1.0, 0.0]), ("bed", [0.0, 1.0]), ("red", [1.0, 1.0])]
DOCS = [("1", ["sofa", "red", "sofa"]), ("2", ["bed", "red"]), ("3", ["red"]), ("4", ["lamp"])]


@pytest.fixture
def words(spark):
    return spark.createDataFrame(WORDS, "word string, vec array<double>")


@pytest.fixture
def docs(spark, words):
    raw = spark.createDataFrame(DOCS, "id string, tokens array<string>")
    return terms.keep_vocabulary_tokens(raw, words)


@pytest.mark.parametrize("bound", [0, 100])
def test_vocabulary_filter_keeps_order_and_repeats(spark, words, bound):
    rows = DOCS + [("5", []), ("6", None), ("7", ["x", "bed", "x", "red", "y"])]
    raw = spark.createDataFrame(rows, "id string, tokens array<string>").repartition(2)
    got = terms.keep_vocabulary_tokens(raw, words, max_broadcast_words=bound)
    assert dict(got.select("id", "tokens").collect()) == {
        "1": ["sofa", "red", "sofa"], "2": ["bed", "red"], "3": ["red"], "7": ["bed", "red"]
    }


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_tfidf_vectors(docs, words, bound):
    got = dict(titles.tfidf_title_vectors(docs, words, max_broadcast_bytes=bound).collect())
    # "red" is in every document and so weighs nothing
    assert got == {"1": [1.0, 0.0], "2": [0.0, 1.0], "3": [0.0, 0.0]}


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_mean_vectors(docs, words, bound):
    got = dict(titles.mean_vectors(docs, words, max_broadcast_bytes=bound).collect())
    assert got["1"] == pytest.approx([1.0, 1 / 3]) and got["2"] == pytest.approx([0.5, 1.0])


def test_product_vectors(spark, words):
    rows = [("a", "sofa and bed"), ("b", None), ("c", "lamp"), ("d", "red sofa")]
    df = spark.createDataFrame(rows, "id string, products string")
    got = dict(titles.product_vectors(df, words).collect())
    assert got["a"] == pytest.approx([math.sqrt(0.5)] * 2)
    assert got["d"] == pytest.approx(np.array([2, 1]) / math.sqrt(5))
    for key in "bc":
        assert np.linalg.norm(got[key]) == pytest.approx(1)
    assert got["b"] != got["c"] and got == dict(titles.product_vectors(df.repartition(3), words).collect())


def test_phrases_need_every_word(spark, words):
    phrases = spark.createDataFrame([("sofa and bed",), ("sofa lamp",), ("xbox",)], "phrase string")
    assert [r.phrase for r in titles.phrase_vectors(phrases, words).collect()] == ["sofa and bed"]


def test_smooth_tfidf_matches_numpy(spark):
    docs = spark.createDataFrame(DOCS, "id string, tokens array<string>")
    got = {(r.id, r.word): r.weight for r in terms.tfidf(docs, smooth=True, max_df=0.7).collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    assert got["1", "sofa"] == pytest.approx(1.0) and ("3", "red") not in got and got["4", "lamp"] == pytest.approx(1.0)
    all_terms = {(r.id, r.word): r.weight for r in terms.tfidf(docs, smooth=True).collect()}
    norm = math.hypot(2 * idf(1), idf(3))
    assert all_terms["1", "red"] == pytest.approx(idf(3) / norm)


def test_lsa_equals_dense_svd(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), [f"w{j}" for j in rng.integers(0, 12, 6)]) for i in range(40)] + [("empty", [])]
    docs = spark.createDataFrame(rows, "id string, tokens array<string>")
    weights = terms.tfidf(docs, smooth=True, max_df=0.9).collect()
    ids, names = sorted({r[0] for r in rows}), sorted({w.word for w in weights})
    dense = np.zeros((len(ids), len(names)))
    for w in weights:
        dense[ids.index(w.id), names.index(w.word)] = w.weight
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    want = u[:, :4] * s[:4]
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norms, out=np.zeros_like(want), where=norms > 1e-12)
    # one shard, and shards of a few entries each
    for shard_bytes in (1 << 28, 8 * 14 * 20):
        got = dict(lsa.lsa_title_vectors(docs, 4, shard_bytes=shard_bytes).collect())
        got = np.array([got[i] for i in ids])
        assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    explained = dict(lsa.explained_variance(docs, [2, 4]).collect())
    projected = u * s
    share = lambda k: projected[:, :k].var(axis=0).sum() / dense.var(axis=0).sum()
    assert explained[2] == pytest.approx(share(2)) and explained[4] == pytest.approx(share(4))
    with pytest.raises(ValueError, match="vocabulary"):
        lsa.lsa_title_vectors(docs, 300)


@pytest.mark.parametrize("shard_bytes", [1 << 28, 8 * 15 * 400])
def test_lsa_of_a_large_vocabulary(spark, shard_bytes):
    """More terms and documents than directions; values, products, and the same on any partitioning."""
    rng = np.random.default_rng(5)
    topics = rng.dirichlet(np.full(400, 0.05), 6)
    rows = [(i, [f"w{j}" for j in rng.choice(400, 30, p=0.9 * topics[i % 6] + 0.1 / 400)] + [f"own{i}"]) for i in range(150)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    weights = terms.tfidf(docs, smooth=True, max_df=0.9).collect()
    names = {w: k for k, w in enumerate(sorted({w.word for w in weights}))}
    dense = np.zeros((150, len(names)))
    for w in weights:
        dense[w.id, names[w.word]] = w.weight
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    runs = []
    for n in (1, 5) if shard_bytes < 1 << 28 else (3,):
        projected, values = lsa.lsa_projection(docs.repartition(n), 5, iterations=6, shard_bytes=shard_bytes)
        assert np.allclose(values, s[:5], rtol=1e-5)
        got = dict(projected.collect())
        runs.append(np.array([got[i] for i in range(150)]))
        assert np.allclose(runs[-1] @ runs[-1].T, (u[:, :5] * s[:5] ** 2) @ u[:, :5].T, atol=1e-3)
    assert np.allclose(runs[0], runs[-1], atol=1e-9)


def test_stemmed_tokens(spark):
    df = spark.createDataFrame([("1", "Red Sofas & beds"), ("2", "...")], "id string, title string")
    got = dict(titles.stemmed_tokens(df, stop_words=["red"]).collect())
    assert got["1"] == ["sofa", "&", "bed"] and got["2"] == [".", ".", "."]


def test_component_removal(docs, words, spark):
    plain = dict(weighted_document_vectors(docs, words, remove_component=False).collect())
    damped = dict(weighted_document_vectors(docs, words).collect())
    x = np.array([plain[k] for k in sorted(plain)])
    u = np.linalg.svd(x - x.mean(axis=0))[2][0]
    assert np.allclose([damped[k] for k in sorted(plain)], x * (1 - u**2))


def test_top_values_break_ties_by_name(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "a", "b", "c", None, None, None]], "p string")
    assert [tuple(r) for r in terms.top_values(df, "p", 2).collect()] == [("a", 2), ("b", 2)]


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_repeated_words_and_ids(spark, limit):
    words = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [1.0, 2.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([("x", ["a", "a"]), ("x", ["a"])], "id string, tokens array<string>")
    got = titles.sum_word_vectors(docs, words, max_broadcast_bytes=limit).collect()
    assert sorted((r.id, list(r.total), r.n) for r in got) == [("x", [1.0, 2.0], 1), ("x", [2.0, 4.0], 2)]


PRODUCTS = [("1", "sofa and red"), ("2", "bed"), ("2", "lamp"), ("3", "lamp"), ("4", None), (None, "red"), (None, "oak"), ("2", "red red")]


def test_product_vectors_of_repeated_and_missing_ids_either_way(spark, words):
    products = spark.createDataFrame(PRODUCTS, "id string, products string")
    near, joined = (
        sorted((str(r.id), [round(x, 12) for x in r.product_vec]) for r in titles.product_vectors(products, words, max_broadcast_bytes=b).collect())
        for b in (1 << 20, 0)
    )
    assert near == joined and len(near) == 11


def test_product_vectors_are_made_after_the_join(spark, words, capsys):
    products = spark.createDataFrame(PRODUCTS, "id string, products string")
    titles.product_vectors(products, words).explain()
    plan = capsys.readouterr().out
    assert plan.index("MapInArrow") < plan.index("Join")


@pytest.mark.parametrize("repeated", [False, True])
def test_vocabulary_tokens_without_a_shuffle_of_tokens(spark, words, capsys, repeated):
    rows = DOCS + [("5", None), (None, ["x", "red", "bed"])] + ([("1", ["bed", "x"]), (None, ["sofa"])] if repeated else [])
    raw = spark.createDataFrame(rows, "id string, tokens array<string>").repartition(3)
    near, joined = (terms.vocabulary_tokens(raw, words, max_broadcast_words=b) for b in (100, 0))
    ordered = lambda df: sorted((str(r.id), r.tokens) for r in df.collect())
    assert ordered(near) == ordered(joined)
    near.explain()
    assert repeated or "Generate" not in capsys.readouterr().out


@pytest.mark.parametrize("limit", [1000, 5, 0])
def test_tfidf_keeps_terms_with_their_document(spark, limit):
    """The same weights with all words sent out, without single ones, and with a join."""
    rows = [
        (1, ["a", "b", "a", None]), (2, ["b", "c"]), (3, []), (4, None), (5, ["b", "b", "d", "e"]),
        (2, ["c", "a", "x"]), (None, ["a", "q"]), (None, ["q", "b"]), (8, ["zz", "b", "e"]),
    ]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    for found in (docs, docs.where("id IN (1, 3, 4, 5, 8)")):
        weights = terms.tfidf(found, max_broadcast_words=limit)
        if limit and found is not docs:
            plan = weights._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Window" not in plan
        count, every = {}, found.collect()
        for key, tokens in every:
            for word in tokens or []:
                if word is not None:
                    count[key, word] = count.get((key, word), 0) + 1
        df = {w: sum(word == w for _, word in count) for _, w in count}
        raw = {kw: tf * math.log2(len(every) / df[kw[1]]) for kw, tf in count.items() if df[kw[1]] < len(every)}
        norm = {k: math.sqrt(sum(v * v for (key, _), v in raw.items() if key == k)) for k, _ in raw}
        got = {(r.id, r.word): (r.tf, r.df, round(r.weight, 9)) for r in weights.collect()}
        assert got == {(k, w): (count[k, w], df[w], round(v / norm[k], 9)) for (k, w), v in raw.items()}


def test_texts_of_one_row_group_are_spread(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(3000), "text": [f"{i} " * 300 for i in range(3000)]}), tmp_path / "documents.parquet", row_group_size=3000)
    cut = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        found = texts(spark, str(tmp_path), "documents")
        assert found.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
        assert found.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)


def test_lsa_waves_hold_few_shards_and_change_nothing(spark, monkeypatch):
    from pathlib import Path

    from kindred.session import shared_dir

    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, [f"w{w}" for w in rng.integers(0, 60, 12)]) for i in range(200)], "id long, tokens array<string>")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    runs = []
    for wave_bytes in (1 << 31, 1):  # the second: two shards per core
        monkeypatch.setattr(lsa, "WAVE_BYTES", wave_bytes, raising=False)
        before = set(folder.iterdir())
        projected, values = lsa.lsa_projection(docs, 5, iterations=2, oversample=3, shard_bytes=8000)
        runs.append((values, dict(projected.collect())))
        left = {p.name.rsplit("-", 1)[0]: str(p) for p in set(folder.iterdir()) - before}
    held = spark.read.parquet(left["lsa-wave"]).where("kind = 'p'").select("shard").distinct().count()
    assert 0 < held < spark.read.parquet(left["lsa-documents"]).select("shard").distinct().count()
    assert np.allclose(runs[0][0], runs[1][0])
    assert all(np.allclose(v, runs[1][1][k], atol=1e-9) for k, v in runs[0][1].items()) and len(runs[0][1]) == 200


def test_products_of_known_length_are_the_same(spark):
    from kindred.functions.vectors import dot

    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=16).tolist(), rng.normal(size=16).tolist()) for _ in range(50)] + [(None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(dot(df.a, df.b).alias("plain"), dot(df.a, df.b, 16).alias("written")).collect()
    assert all(r.plain == r.written for r in got) and got[-1].written is None
