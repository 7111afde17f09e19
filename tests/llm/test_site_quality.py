import math
import random

from kindred.llm import site_quality as sq

SCHEMA = "doc_id long, text string, source string, lang string, evidence string"


def corpus(n=600):
    rng = random.Random(4)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if bad:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["Awful", "rubbish,", "awful!"])
        rows.append((i, " ".join(text), f"s{i % 7}", "en" if i % 3 else "de", None))
        if i % 2:
            labels.append((i, 0 if bad and i % 4 else 1, 1 if bad else 0))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus()
    edges = [(9001, None, None, None, "x"), (9002, "", "s1", None, "x"), (None, "worda", "s1", "en", "x"), (9003, "awful " * 50_000, "s2", "en", "x"), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows + edges, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sq.classify(df, lab).collect()
    assert len(got) == len(rows) + len(edges)
    by = {r.doc_id: r for r in got}
    right = [by[i].kept == (i % 5 != 0) for i in range(0, 600, 2)]
    assert sum(right) / len(right) > 0.95
    assert not by[9003].kept and all(0 <= r.p_bad <= 1 for r in got)
    none = sq.classify(df, lab.limit(0)).collect()
    assert len(none) == len(got) and all(r.evidence == 0 for r in none)
    assert sq.classify(df.limit(0), lab).count() == 0


def test_posteriors_equal_the_formulas(spark):
    rows, labels = corpus(200)
    got = sq.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = [x for x in labels if x[0] < 200]
    rate = sum(1 for _, q, t in known if q == 0 or t == 1) / len(known)
    own = {r.doc_id: 1 / (1 + math.exp(-(r.evidence + math.log(rate / (1 - rate))))) for r in got}
    spec = sq.Sites()

    def strength(units):
        n = sum(u[0] for u in units)
        squares = sum(u[0] ** 2 for u in units)
        between = sum(m * (b / m - c) ** 2 for m, b, c in units)
        chance = sum(m * c * (1 - c) for m, b, c in units) / n
        beyond = (between - (len(units) - 1) * chance) / (n - squares / n)
        return min(max(chance / beyond - 1, spec.floor), spec.ceiling) if beyond > 0 else spec.ceiling

    def group(key):
        out = {}
        for r in got:
            n, b = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, b + own[r.doc_id])
        return out

    mean = sum(own.values()) / len(own)
    hosts, paths = group(lambda r: r.host), group(lambda r: (r.host, r.path))
    pull = strength([(n, b, mean) for n, b in hosts.values()])
    host_rate = {h: (b + pull * mean) / (n + pull) for h, (n, b) in hosts.items()}
    tie = strength([(n, b, host_rate[h]) for (h, _), (n, b) in paths.items()])
    for r in got:
        n, b = paths[r.host, r.path]
        assert math.isclose(r.path_rate, (b + tie * host_rate[r.host]) / (n + tie), rel_tol=1e-9)
        others = min(max((b - own[r.doc_id] + tie * host_rate[r.host]) / (n - 1 + tie), 1e-6), 1 - 1e-6)
        assert math.isclose(r.p_bad, 1 / (1 + math.exp(-(r.evidence + math.log(others / (1 - others))))), rel_tol=1e-6)
