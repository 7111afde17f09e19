import random
import re

import pytest

from kindred.llm import minhash_dedup as md
from kindred.llm.components import connected_components

SCHEMA = "doc_id long, text string, n_shingles string, component_id string"


def brute(rows, width=2):
    """Components by comparing every pair."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        sets[doc_id] = grams or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, len(base) // 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n := n + 1, rng.choice([" ", "\n", " \t "]).join(copy).replace("w1", rng.choice(["w1", "W1"]))))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "  \n"), (n + 4, "one"), (n + 5, "ONE "), (n + 6, "one two"), (n + 7, "x " * 5000)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small):
    rows = corpus()
    join = md.Join(shingle=2, leaf=4, block_docs=3, block_shingles=300) if small else md.Join(shingle=2)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in md.dedup(df, join).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", None, None), (1, "a b c", None, None), (None, "a b c", None, None), (0, "A b  c", None, None)], SCHEMA)
    out = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in md.dedup(df, md.Join(2)).collect())
    assert out == [(False, 0, 0, True), (False, 1, 0, False), (False, 1, 0, False), (True, 0, None, True)]
    assert md.drop_duplicates(df, md.Join(2)).columns == df.columns
    assert md.dedup(df.limit(0), md.Join(2)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [r for r in corpus() if r[1] is not None] * 2
    # repeated rows of one id, alike and not, and rows in no group
    rows += [(-1, "p q r s t"), (-1, "p q r s t"), (-1, "P q r s t"), (-2, "u v w"), (-2, "x y z"), (None, "a b"), (None, "a b"), (-3, None), (-3, ""), (-3, "i j k"), (-3, "i j k"), (-1, " ")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in md.drop_duplicates(df, md.Join(2)).collect()]
    found = brute([r for r in corpus() if r[1] is not None])
    want = {i for i, (n, root) in found.items() if n and i == root}
    have = [i for i, t in got if i is not None and i > 0 and t.strip()]
    assert sorted(have) == sorted(want)
    assert sum(i is not None and i > 0 and not t.strip() for i, t in got) == 2 * sum(not n for n, _ in found.values())
    rest = sorted((str(i), str(t)) for i, t in got if i is None or i < 0)
    assert rest == [("-1", " "), ("-1", "P q r s t"), ("-2", "u v w"), ("-3", ""), ("-3", "None"), ("-3", "i j k"), ("None", "a b"), ("None", "a b")]


def test_repeated_clean_document_survives_the_next_stage(spark):
    from kindred.llm import suffix_dedup

    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(5, text, "x", "y")] * 2, SCHEMA)
    assert [r.text for r in suffix_dedup.cut_repeats(md.drop_duplicates(df)).collect()] == [text]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5), (None, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {7: 3, 9: 3}


def test_ids_that_go_are_not_sent_through_the_driver(spark, capsys):
    rows = [(i, "one two three four five six seven") for i in range(5)] + [(i, f"other {i} words that stand alone here") for i in range(5, 8)] + [(None, "x"), (9, None)]
    left = md.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    left.explain()
    plan = capsys.readouterr().out
    assert "LeftAnti" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 0), (False, 5), (False, 6), (False, 7), (False, 9), (True, 0)]
