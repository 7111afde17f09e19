import pytest
from pyspark.sql import functions as F

from kindred.functions.stemming import stem, with_stems
from kindred.functions.text import clean_text, title_tokens, word_tokens

GOLDEN = [
    ("3'", "^ inches"),
    ('36" Sofa, w/ Arms|Grey', "^^ feet sofa ,  with  arms  ,  grey"),
    ("<b>Bed</b> &amp; Frame #2 item#3", " bed  and frame #^ item number^"),
    ("1,200.50 - $5.", "^,^^^.^^  ,   dollars ^ . "),
    ("5-piece Set (A_B) x=4", "^ , piece set  a b  x = ^"),
    ("a, - , b", "a ,  b"),
    ("TV&quot;s 42&quot; item-5", "tvs ^^ feet item-^"),
    ("Crème Brûlée Größe", "creme brulee grosse"),
    ("12” × 3½’", "^^ feet x ^^/^ inches"),
    ("日本 table", " table"),
    ("<a\nb> c", "<a\nb> c"),
    ("`x` a## b#c", "x a number# b numberc"),
    (None, None),
]


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_clean_text_golden(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = dict(rows.select("i", clean_text(F.col("t"))).collect())
    assert [got[i] for i in range(len(GOLDEN))] == [want for _, want in GOLDEN]


def test_clean_text_parameters(spark):
    swapped = one(spark, "3' (x)", lambda c: clean_text(c, eliminated="[x]", unit_words=("feet", "inches")))
    assert swapped == "^ feet ( )"


def test_cleaned_text_is_plain(spark):
    from checks.fixtures import table

    cleaned = table(spark, "/root/testdata/sf0.001", "pages").select(clean_text(F.col("html")).alias("c"))
    assert cleaned.where(F.col("c").rlike(r"[^\x00-\x7F]|[0-9A-Z]")).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("sofa ,  with arms", ["sofa", ",", "with", "arms"]),
        ("cannot wanna cannots", ["can", "not", "wan", "na", "cannots"]),
        ("item #^ a&b ^,^^^.^^ .", ["item", "#", "^", "a", "&", "b", "^", ",", "^^^.^^", "."]),
        ("", []),
    ],
)
def test_word_tokens(spark, text, want):
    assert one(spark, text, word_tokens) == want


def test_title_tokens_drop_stop_words_and_keep_repeats(spark):
    assert one(spark, "The Bed and the Bed", title_tokens) == ["bed", "bed"]
    assert one(spark, "The Bed", lambda c: title_tokens(c, [])) == ["the", "bed"]


@pytest.mark.parametrize(
    "word,want",
    [
        ("consistently", "consist"), ("knackeries", "knackeri"), ("generously", "generous"), ("ties", "tie"),
        ("cries", "cri"), ("gas", "gas"), ("happy", "happi"), ("hopping", "hop"), ("hoping", "hope"),
        ("relational", "relat"), ("skies", "sky"), ("news", "news"), ("by", "by"), ("say", "say"),
        ("upholstered", "upholst"), ("adoption", "adopt"), ("controlling", "control"), ("national", "nation"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


def test_with_stems(spark):
    words = spark.createDataFrame([("beds",), ("chairs",)], "word string")
    assert dict(with_stems(words).collect()) == {"beds": "bed", "chairs": "chair"}
