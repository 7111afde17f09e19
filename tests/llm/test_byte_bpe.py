import random

import public_tokenizers
import pytest
import tiktoken

from kindred.llm import byte_bpe as bb
from kindred.llm.queries import QUERIES

TOKENS = bb.read_vocabulary(bb.VOCABULARY)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice("ab '\n\tèß漢1　!s're🙂") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    out += ["x" * 3000, " " * 2500 + "a", "a" + " " * 2500, "'" * 900 + "re", "we're we'll " * 200, "1" * 700 + "é" * 700, " \n" * 800 + "!", "漢" * 600]
    return out


def want(rows):
    return sorted((i is not None, i or 0, KNOWN.encode_ordinary(t or "")) for i, t in rows)


def got(out):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in out.select("doc_id", "ids").collect())


@pytest.mark.parametrize("chunk, overlap", [(32, 8), (100, 100), (1 << 16, 1 << 11)])
def test_equals_the_library_and_decodes(spark, chunk, overlap):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (4, "other " * 60), (4, "text " * 60), (None, "no id " * 50), (None, None), (500, None), (501, "")]
    df = spark.createDataFrame([(*r, "clash", 1, b"z") for r in rows], "doc_id long, text string, ids string, row int, data binary")
    out = bb.encode(df, chunk=chunk, overlap=overlap)
    assert got(out) == want(rows)
    back = bb.decode(out).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.data)) for r in back) == sorted((i is not None, i or 0, (t or "").encode()) for i, t in rows)


def test_empty_table_and_bad_input(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bb.encode(none).count() == 0 and bb.decode(bb.encode(none)).count() == 0
    with pytest.raises(ValueError):
        bb.encode(none, chunk=10, overlap=20)
    with pytest.raises(Exception, match="no token"):
        bb.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>")).collect()
    assert bb.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().data is None


def test_pieces_together_alone_and_forgotten():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdetsiné") for _ in range(rng.randint(1, 90))) for _ in range(800)]
    for merges in (bb.Merges(TOKENS), bb.Merges(TOKENS, longest=0), bb.Merges(TOKENS, remember=5, longest=1000)):
        for part in (words[:500], words[300:]):
            assert [a.tolist() for a in merges.encode([[w] for w in part])] == [KNOWN.encode_ordinary(w) for w in part]


def test_seam_ignores_unsettled_boundaries():
    import numpy as np

    # the chunk has 10 characters, 14 are seen; 13 may move with what follows
    assert bb.seam(np.array([4, 9, 13, 14]), np.array([3, 4]), 10, 14) is None
    assert bb.seam(np.array([4, 9, 12, 14]), np.array([2, 4]), 10, 14) == 2
    assert bb.seam(np.array([4, 10, 14]), np.array([2, 4]), 10, 14) == 0


def test_query(spark):
    import hashlib

    import numpy as np

    rows = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc, text in docs:
        ids = KNOWN.encode_ordinary(text or "")
        row = rows[doc]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
