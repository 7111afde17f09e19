import math
from itertools import product

import numpy as np
import pytest

from kindred.operators import embeddings as e
from kindred.operators import quality as q


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    topics = [[f"{t}{i}" for i in range(20)] for t in ("bed", "sofa")]
    rows = [(f"d{i}", [topics[i % 2][j] for j in rng.integers(0, 20, 40)] + (["rare"] if i == 0 else [])) for i in range(60)]
    return spark.createDataFrame(rows + [("none", ["unknown"])], "doc string, tokens array<string>")


def test_word_vectors(corpus):
    words = e.train_word_vectors(corpus, dim=8, epochs=2)
    rows = dict(words.collect())
    assert set(rows) == {f"{t}{i}" for t in ("bed", "sofa") for i in range(20)}
    assert all(len(v) == 8 for v in rows.values())


def test_document_vectors_follow_topics_and_repeat(corpus):
    docs, words = e.train_document_vectors(corpus, dim=8, epochs=6, alpha=0.1, shard_tokens=800)
    vecs = dict(docs.collect())
    assert set(vecs) == {f"d{i}" for i in range(60)} | {"none"}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in vecs.items()}
    same = np.mean([unit["d2"] @ unit[f"d{i}"] for i in range(4, 40, 2)])
    other = np.mean([unit["d2"] @ unit[f"d{i}"] for i in range(5, 41, 2)])
    assert same > other
    inferred = [dict(e.infer_document_vectors(corpus, words, shard_tokens=n).collect()) for n in (500, 100_000)]
    assert set(inferred[0]) == set(vecs)
    again = dict(e.infer_document_vectors(corpus.repartition(5), words, shard_tokens=500).collect())
    assert all(np.allclose(inferred[0][k], again[k]) for k in vecs)


def test_infer_alone_equals_batch(corpus):
    _, words = e.train_document_vectors(corpus, dim=8, epochs=2, alpha=0.1, shard_tokens=800)
    batch = dict(e.infer_document_vectors(corpus, words, shard_tokens=300).collect())
    for doc in ("d3", "d17", "none"):
        alone = dict(e.infer_document_vectors(corpus.where(f"doc = '{doc}'"), words).collect())
        assert list(alone) == [doc] and alone[doc] == batch[doc]


def test_tagged_corpus(corpus):
    both = e.tagged_corpus(c=corpus, t=corpus)
    assert both.count() == 2 * corpus.count() and both.select("doc").distinct().count() == both.count()


def expected_information(a, b, n):
    choose = math.comb
    return sum(
        m / n * math.log(n * m / (a * b)) * choose(a, m) * choose(n - a, b - m) / choose(n, b)
        for m in range(max(1, a + b - n), min(a, b) + 1)
    )


def test_cluster_agreement(spark):
    rng = np.random.default_rng(1)
    rows = [(int(x), str(int(x + rng.integers(0, 2)) % 3)) for x in rng.integers(0, 3, 90)]
    table = q.contingency(spark.createDataFrame(rows, "c int, l string"), "c", "l")
    n = len(rows)
    a, b, both = ({k: sum(1 for r in rows if f(r) == k) for k in set(map(f, rows))}
                  for f in (lambda r: r[0], lambda r: r[1], lambda r: r))
    pairs = lambda counts: sum(math.comb(v, 2) for v in counts.values())
    expected = pairs(a) * pairs(b) / math.comb(n, 2)
    want = (pairs(both) - expected) / ((pairs(a) + pairs(b)) / 2 - expected)
    assert q.adjusted_rand(table).first()[0] == pytest.approx(want)
    entropy = lambda counts: -sum(v / n * math.log(v / n) for v in counts.values())
    information = sum(v / n * math.log(n * v / (a[x] * b[y])) for (x, y), v in both.items())
    emi = sum(expected_information(x, y, n) for x, y in product(a.values(), b.values()))
    want = (information - emi) / (max(entropy(a), entropy(b)) - emi)
    assert q.adjusted_mutual_information(table).first()[0] == pytest.approx(want)


def test_classifiers(spark):
    rng = np.random.default_rng(2)
    rows = [([float(x) for x in rng.normal(size=2) + 4 * (i % 2)], str(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "v array<double>, label_name string")
    quality = q.classifier_quality(df, "v", "label_name", regParam=0.01).first()
    assert quality.accuracy > 0.9 and quality.log_loss < 0.4
    tuned = q.tune_classifier(df, "v", "label_name", [{"regParam": 10.0}, {"regParam": 0.01}], folds=2).collect()
    assert "0.01" in tuned[0].setting and tuned[0].log_loss < tuned[1].log_loss


def test_training_job(spark, corpus, tmp_path):
    from kindred.plans.train import train

    titles = corpus.limit(5)
    paths = train(corpus, str(tmp_path / "models"), dim=4, titles=titles, epochs=1)
    assert spark.read.parquet(paths["words"]).count() == 40
    assert spark.read.parquet(paths["documents"]).count() == corpus.count() + 5


def test_inference_of_short_documents_is_spread_and_in_batches(spark, corpus, monkeypatch):
    _, words = e.train_document_vectors(corpus, dim=8, epochs=1)
    short = spark.createDataFrame([(f"s{i}", [f"bed{i % 20}"] * (i % 4)) for i in range(400)], "doc string, tokens array<string>")
    shards, sharded = [], e._sharded
    monkeypatch.setattr(e, "_sharded", lambda *a, **k: shards.append(sharded(*a, **k)) or shards[-1])
    together = dict(e.infer_document_vectors(short, words, shard_tokens=1_000).collect())
    assert shards[0][2] >= 400 * e.STEP // 1_000  # their 600 tokens alone would be one shard
    few = dict(e.infer_document_vectors(short.where("doc IN ('s1', 's7', 's399')"), words).collect())
    assert len(together) == 400 and all(np.allclose(together[d], v, rtol=0, atol=1e-12) for d, v in few.items())


def test_waves_of_documents_hold_few_words(spark, corpus, monkeypatch):
    from pathlib import Path

    from kindred.operators import skipgram
    from kindred.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    runs = []
    for wave_bytes in (1 << 31, 1):  # the second: two shards per core
        monkeypatch.setattr(skipgram, "WAVE_BYTES", wave_bytes)
        before = set(folder.iterdir())
        docs, words = e.train_document_vectors(corpus.repartition(1), dim=4, epochs=2, alpha=0.1, shard_tokens=100, pool=30)
        inferred = e.infer_document_vectors(corpus, words, epochs=2, shard_tokens=100, pool=30)
        runs.append([dict(docs.collect()), {r.word: (r["count"], *r.win, *r.wout) for r in words.collect()}, dict(inferred.collect())])
        left = {p.name.rsplit("-", 1)[0]: str(p) for p in set(folder.iterdir()) - before}
    wave = spark.read.parquet(left["wave"])
    assert spark.read.parquet(left["shard-words"]).select("shard").distinct().count() > wave.select("shard").distinct().count()
    assert words.columns == ["word", "count", "win", "wout"]
    for one, many in zip(*runs):
        assert set(one) == set(many) and all(np.allclose(one[k], many[k], rtol=0, atol=1e-12) for k in one)
