import math
import random
import re
from collections import Counter, defaultdict

from kindred.llm import mixing, url_filters
from kindred.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts_and_verdicts(spark):
    rng = random.Random(1)
    words = ["über", "the", "a", "naïve", "x&&", "日本", "of"]
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 4, "é\u00a0é " * 30, "l\nl\n\nl\n l", "w " * 30_000]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\x0b"]) for _ in range(rng.randint(1, 200))) for _ in range(80)]
    good = ["the river and the stone in the market of the town by the old bridge " + " ".join(rng.sample(["sun", "moon", "sky", "tree", "road", "hill", "gate"], 7)) for _ in range(60)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts + good)] + [(None, "a", "x", 1), (3, texts[3], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(len(texts) + i, 1, 0) for i in range(50)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = qr.judge(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r[1:7]) == base((texts + good)[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert all(r.kept for r in got if (r.doc_id or 0) >= len(texts))
    kept = qr.keep_good(df, labels)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert qr.judge(df.limit(0), labels).count() == 0 and qr.judge(df, labels.limit(0)).count() == len(rows)


def test_log_ratio_is_the_one_of_two_multinomials(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    ratio, threshold = qr.fit(df, labels, qr.Rules(buckets=64, held_out=10**9))
    assert threshold <= 0 and (ratio > 0).sum() in range(1, 5)


def test_every_trusted_document_counts(spark):
    """More trusted documents than a bounded sample would hold; the last of them alone have the word b."""
    n = 24_000
    df = spark.range(n + 1000).selectExpr("id AS doc_id", "CASE WHEN id < 4000 THEN 'b' WHEN id < 24000 THEN 'a' ELSE 'c' END AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    rules = qr.Rules(buckets=64, threshold=0.0)
    ratio, _ = qr.fit(df, labels, rules)
    learned = df.where(f"doc_id < {n} AND pmod(xxhash64(doc_id), {rules.held_out}) <> 0").groupBy("text").count().collect()
    good, corpus = {r["text"]: r["count"] for r in learned}, {"a": 20_000, "b": 4_000, "c": 1_000}
    total, weight = sum(good.values()), 64 + sum(good.values())
    share = {w: (k + 1) / (n + 1000 + 64) for w, k in corpus.items()}
    want = [math.log((good.get(w, 0) + weight * p) / (total + weight)) - math.log(p) for w, p in share.items()]
    assert sorted(x for x in ratio.round(9) if abs(x + math.log((total + weight) / weight)) > 1e-6) == sorted(round(x, 9) for x in want if abs(x + math.log((total + weight) / weight)) > 1e-6)


def test_quantile_equals_the_one_over_all_rows(spark):
    rng = random.Random(8)
    for size in (1, 2, 3, 50, 40_000):
        values = spark.createDataFrame([(rng.choice([rng.gauss(0, 1), 0.5, None]),) for _ in range(size)] + [(0.25,)], "x double")
        for share in (0.0, 0.001, 0.3, 1.0):
            want = values.selectExpr(f"percentile(x, {share}D)").first()[0]
            assert abs(qr.quantile(values, "x", share) - want) < 1e-9
    assert qr.quantile(values.limit(0), "x", 0.1) is None


def test_likely_rows_hold_all_trusted_and_few_others(spark):
    ids = [*range(-300, 300), 2**62, -(2**63), None]
    docs = spark.createDataFrame([(i, str(i)) for i in ids] * 2, "doc_id long, text string")
    trusted = docs.where("doc_id % 3 = 0").select("doc_id").distinct()
    got = Counter(r.doc_id for r in qr._likely(docs, trusted).collect())
    assert got == Counter(i for i in ids * 2 if i is not None and math.fmod(i, 3) == 0)
    assert set(r.doc_id for r in qr._likely(docs, trusted, bits=64).collect()) >= set(got)


def glob_fits(glob, text):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "\\":
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "."}.get(glob[i], re.escape(glob[i])), i + 1
    return re.fullmatch(out, text, re.S) is not None


def test_automaton_equals_regular_expressions():
    import numpy as np

    rng = random.Random(2)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    fits = url_filters.Automaton(globs).run(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [[bool(x) for x in row] for row in fits] == [[glob_fits(g, t) for g in globs] for t in texts]


def test_site_rules(spark):
    urls = ["http://a.ORG/x", "x://org", "https://q.example.org/es/1?q", "https://example.org/en/12#t", "http://notexample.org/es/", "a.com/fr/", None, "", "http://z.com/de/1", "http://z.com/fr/", "http://c.net/a.zip", "p://h?x/y", "http://É.com/de/" + "l" * 9000]
    df = spark.createDataFrame([(i, u, "w") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1] == ("org", "", None, "allow")
    assert got[2][2:] == ("example.org/es/", "block") and got[3][1:] == ("/en/12", "example.org/en/1", "block")
    assert got[4][2:] == ("org/", "allow") and got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("com/de/", "block") and got[9][2:] == ("com/fr/", "allow") and got[10][2:] == (None, "block")
    assert got[11][:2] == ("h", "") and got[12][0] == "É.com" and got[12][2:] == ("com/de/", "block")
    assert url_filters.judge_urls(df).count() == 2 * len(urls) and url_filters.judge_urls(df.limit(0)).count() == 0


def targets(sizes):
    """The targets by sharing again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        extra = 0.0
        for s in sorted(open_, key=str):
            out[s] += left * weight[s] / total
            if out[s] > 2 * sizes[s]:
                extra += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                weight[s] = 0
        open_ = {s for s in open_ if weight[s]}
        left = extra
    return out


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(0, 40)), rng.choice(["b", "a", "é", "z", "hot", "hot", "hot", None])) for i in range(500)]
    rows += [(600, None, "a"), (601, "", "empty"), (602, "x y", "tiny"), (603, "q " * 9000, "long"), (604, None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, taken string")
    spec = mixing.Mix(bucket_rows=7)
    got = mixing.plan(df, spec).collect()
    assert len(got) == len(rows)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    per = defaultdict(int)
    for i, _, s in rows:
        per[s] += size[i]
    want, taken = targets(per), defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == per[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in per)
    assert sorted(map(str, mixing.plan(df, spec).collect())) == sorted(map(str, got))
    out = mixing.mixed(df, spec)
    assert out.columns == df.columns
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    assert words == sum(taken.values())
    assert mixing.plan(df.limit(0)).count() == 0 == mixing.mixed(df.limit(0)).count()


def test_equal_rows_take_their_own_passes(spark):
    ten = " ".join("abcdefghij")
    rows = [(1, ten, "a", i % 2) for i in range(6)] + [(1, ten, "b", 7), (1, "other words", "a", 0), (None, ten, None, 1), (None, ten, None, 1)]
    rows += [(9, "w " * 30, "c", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    taken = defaultdict(int)
    for r in mixing.plan(df).collect():
        taken[r.source] += r.taken
    out, words = mixing.mixed(df).collect(), defaultdict(int)
    for r in out:
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == {s: n for s, n in taken.items() if n}


def test_order_ascends_over_partitions(spark):
    df = spark.createDataFrame([(i, "w " * (i % 30), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = mixing.in_training_order(mixing.plan(df)).select("position", "doc_id").rdd.glom().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    flat = [(r.position is None, r.position or 0, r.doc_id) for part in parts for r in part]
    assert flat == sorted(flat) and len(flat) == 400 and sum(map(bool, parts)) > 1


def test_demand_is_inverted(spark):
    df = spark.range(101).selectExpr("id / 100.0D as u").select("u", *[mixing.demand_time(__import__("pyspark").sql.functions.col("u"), __import__("pyspark").sql.functions.lit(b)).alias(f"t{i}") for i, b in enumerate((-0.5, 0.0, 0.8))])
    for r in df.collect():
        for i, b in enumerate((-0.5, 0.0, 0.8)):
            t = r[f"t{i}"]
            assert abs((1 - b) * t + b * t * t - r.u) < 1e-9
