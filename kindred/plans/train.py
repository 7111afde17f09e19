"""Training job: a corpus in, word and document embeddings out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kindred.operators.embeddings import tagged_corpus, train_document_vectors, train_word_vectors
from kindred.sources.sinks import write_snapshot


def train(
    corpus: DataFrame,
    output: str,
    dim: int = 300,
    titles: DataFrame | None = None,
    min_count: int = 5,
    word_window: int = 3,
    phrase_window: int = 5,
    document_window: int = 4,
    epochs: int = 10,
    seed: int = 11,
) -> dict[str, str]:
    """Train and save the three models of a corpus ``doc, tokens``.

    The second word table also learns word n-grams of up to three words; the document model also learns from
    ``titles`` when given (with a window of 5). Returns the written paths.
    """
    paths = {name: f"{output.rstrip('/')}/{name}" for name in ("words", "phrase_words", "documents", "document_words")}
    write_snapshot(train_word_vectors(corpus, dim, word_window, min_count, seed), paths["words"])
    write_snapshot(train_word_vectors(corpus, dim, phrase_window, min_count, seed, ngrams=3), paths["phrase_words"])
    if titles is not None:
        corpus, document_window = tagged_corpus(c=corpus, t=titles), 5
    documents, words = train_document_vectors(corpus, dim, document_window, min_count, epochs, seed=seed)
    write_snapshot(documents, paths["documents"])
    write_snapshot(words, paths["document_words"])
    return paths
