"""Title normalisation and tokenisation as Spark string expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.wordlists import (
    ENGLISH_STOP_WORDS,
    MULTI_LETTER_FOLDS,
    SINGLE_LETTER_FOLDS,
)

# Characters replaced by a space, and the words written for the two
# measure marks (foot mark first; the pairing is the established behaviour).
ELIMINATED = r"[():?*;!\[\]_~{}^|\\]"
UNIT_WORDS = ("inches", "feet")

# One punctuation mark, or a run without blanks and such marks.
TOKEN = r"([#@%&<>,]|[^\s#@%&<>,]+)"

# Fused words that count as two tokens.
FUSED_WORDS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))


def _latin_letters() -> dict[str, str]:
    """Accented Latin letters by Unicode decomposition (a rule, not a table)."""
    folds = {}
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            letter = chr(code)
            base = [c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)]
            if len(base) == 1 and base[0] != letter and base[0].isascii():
                folds[letter] = base[0]
    return folds


def fold_ascii(text: Column) -> Column:
    """ASCII spelling of Latin text; other scripts are removed.

    Pure ASCII rows skip the fold.
    """
    single = {**_latin_letters(), **SINGLE_LETTER_FOLDS}
    folded = F.translate(text, "".join(single), "".join(single.values()))
    for letter, spelling in MULTI_LETTER_FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelling))
    folded = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_text(
    text: Column,
    eliminated: str = ELIMINATED,
    unit_words: tuple[str, str] = UNIT_WORDS,
    fold: bool = True,
) -> Column:
    """Normalise one title. A null stays null.

    ``eliminated`` is a regular expression class of characters replaced by a
    space; ``unit_words`` are the words for a single and a double quote after a
    number. The order of the steps is significant.
    """
    text = F.regexp_replace(text, r"<[^>\n]*>", " ")
    text = _swap(text, ("&quot;", '"'), ("&quot", '"'), ("&amp;", "and"), ("&amp", "and"))
    text = _swap(text, ("`", "'"), ("w/", "with "), ("|", " , "))
    if fold:
        text = fold_ascii(text)
    text = F.regexp_replace(text, eliminated, " ")
    text = F.regexp_replace(text, r"#(?<=\w#)", " number")
    text = _swap(text, ("=", " = "))
    text = F.regexp_replace(text, "[0-9]", "^")
    text = F.regexp_replace(text, r",(?!\^)", " , ")
    text = F.regexp_replace(text, r"\.(?!\^)", " . ")
    text = F.regexp_replace(text, r"-(?!\^)", " , ")
    text = F.regexp_replace(text, r"'(?<=\^')", f" {unit_words[0]}")
    text = F.regexp_replace(text, r'"(?<=\^")', f" {unit_words[1]}")
    text = F.regexp_replace(text, "['\"]", "")
    text = _swap(text, ("$", " dollars "))
    text = F.lower(text)
    return F.regexp_replace(text, r",([\s\x1c-\x1f]*,)+", ",")


def word_tokens(cleaned: Column) -> Column:
    """Tokens of a cleaned text, in order, repeats kept."""
    fused = "|".join(rf"{a}(?={b}\b)" for a, b in FUSED_WORDS)
    parted = F.regexp_replace(cleaned, rf"\b({fused})", "$1 ")
    return F.regexp_extract_all(parted, F.lit(TOKEN), F.lit(1))


def without_stop_words(tokens: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words; order and repeats of the rest are kept."""
    stop_words = list(stop_words)
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(stop_words))


def title_tokens(title: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Clean, tokenise and drop stop words (vocabulary is applied by a join)."""
    return without_stop_words(word_tokens(clean_text(title)), stop_words)


def product_words(products: Column) -> Column:
    """Split a product string such as ``sofa and side table`` into its words."""
    return F.split(products, r" and |\s")
