import numpy as np

from kindred.llm import language_id as li

TEXTS = {"en": "the house and the garden with that thing ", "de": "der garten und das haus mit einem ding ", "fr": "le jardin et la maison avec une chose "}


def rows(n=60):
    out = []
    for i in range(n):
        lang = sorted(TEXTS)[i % 3]
        words = TEXTS[lang].split()
        out.append((i, " ".join(words[(i * j + j) % len(words)] for j in range(1, 12)), lang))
    return out


def test_held_out_accuracy_and_edges(spark):
    data = [(*r, "x") for r in rows()] + [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !!", "zz", "x"), (103, "Das Haus " * 20000, None, "x"), (None, "the", None, "x"), (1, "the the", "en", "x"), (1, "the the", "en", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    got = li.identify(df).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    want = {r[0]: r[2] for r in rows()}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert held and all(r.lang_pred == want[r.doc_id] for r in held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    assert li.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in li.predict(df, [], np.zeros((0, 1024))).collect()} == {"und"}


def test_text_vector_is_the_bundle_of_bound_letters():
    spec = li.Profiles(size=64)
    (owner, grams, n), letters = li.text_grams(["Aé b", "..."])
    assert list(letters) == [True, False] and set(owner) == {0} and n.sum() == 4
    a, b, c = li._letter_vectors(64, 7)
    code = li._letter_codes()
    seq = [0, code[ord("a")], code[ord("é")], 0, code[ord("b")], 0]
    want = sum(a[seq[i]] * b[seq[i + 1]] * c[seq[i + 2]].astype(int) for i in range(4))
    assert (n @ li.gram_vectors(grams, spec) == want).all()
