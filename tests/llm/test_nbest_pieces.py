import random

import pytest

from kindred.llm import nbest_pieces as nb


def brute(known, text):
    """Scores of all segmentations of a whole text, without the cut into words."""
    s = " " + text if text else ""
    paths = [[(0.0, ())]]

    def edges(end):
        for begin in range(end):
            if s[begin:end] in known.scores:
                x, i = known.scores[s[begin:end]]
                yield begin, x, (i,)
        if s[end - 1] not in known.scores:
            yield end - 1, known.unknown, tuple(known.byte_id[b] for b in s[end - 1].encode())

    for end in range(1, len(s) + 1):
        paths.append([(a + x, p + ids) for begin, x, ids in edges(end) for a, p in paths[begin]])
    return sorted(paths[-1], key=lambda p: -p[0]) if s else []


@pytest.mark.parametrize("text", ["a", "the cat", "hello", "  x y", "on\nto", "né 日a", "aaaa", "▁a", "\t", "a  b", "", "x▁ y"])
def test_nbest_equals_enumeration(text):
    known = nb.Pieces(nb.MODEL, 6)
    choices, found = known.nbest(text)
    want = brute(known, text)
    assert [s for s, _ in found] == [s for s, _ in want[:6]]
    paths = set()
    for score, changed in found:
        pick = dict(changed)
        ids = tuple(i for w, c in enumerate(choices) for i in (known.others(known.words(text)[w])[pick[w] - 1][1] if w in pick else c[0]))
        assert (score, ids) in want
        assert known.decode(ids) == text
        paths.add(ids)
    assert len(paths) == len(found)


def test_rows(spark):
    rows = [(1, "The cat  sat.\nNow"), (1, "The cat  sat.\nNow"), (2, None), (3, ""), (4, "ab " * 3000 + "é" * 2000), (None, "x")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, text string, ids string, scores int")
    out = nb.encode(df, best=3)
    got = {(r.doc_id, r.ids is None): r for r in out.collect()}
    assert len(out.collect()) == 6 and all(r.decoded for r in got.values())
    assert got[2, True].scores is None and got[3, False].ids == [] and got[3, False].scores == []
    first = got[1, False]
    assert len(first.scores) == 3 == len(first.changes) and first.changes[0] == [] and first.scores == sorted(first.scores, reverse=True)
    change = first.changes[1][0]
    other = first.ids[: change.begin] + change.ids + first.ids[change.begin + change.size :]
    assert nb.Pieces(nb.MODEL, 1).decode(other) == rows[0][1]
    assert sorted((r.doc_id or 0, r.text or "") for r in nb.decode(out).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert nb.encode(df.limit(0)).count() == 0


def test_words_together_equal_words_alone():
    together, alone = nb.Pieces(nb.MODEL, 4), nb.Pieces(nb.MODEL, 4)
    rng = random.Random(5)
    words = {"".join(rng.choice(" aaetionrsh,.é日🙂▁") for _ in range(rng.randint(1, 70))) for _ in range(600)} | {f" the{i}" for i in range(300)}
    together.learn(words, cells=2048)
    assert set(together.known) >= {w for w in words if 8 < len(w) <= 60}
    assert all(len(w) <= together.longest and found == alone.word(w) for w, found in together.known.items())
    together.remember = 10
    together.learn({"x", "y"})
    assert not together.known


def test_a_full_memory_keeps_the_words_in_use():
    known, alone = nb.Pieces(nb.MODEL, 4, remember=60), nb.Pieces(nb.MODEL, 4)
    common = {f" in use{i}" for i in range(20)}
    for batch in range(5):
        known.learn(common | {f" seen{batch}once{i}" for i in range(30)})
        assert common <= set(known.known) and len(known.known) <= 60
    assert all(known.known[w] == alone.word(w) for w in common)
    for i in range(100):
        assert known.word(f" later{i}") == alone.word(f" later{i}")
    assert len(known.known) <= 60 and common <= set(known.known)
