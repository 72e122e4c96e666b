"""Text statistics as native string and array expressions over whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide import specs


# Every Unicode whitespace character, spelled out so that any regex engine agrees.
WHITESPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def words(text: Column) -> Column:
    """Lower-cased whitespace tokens, punctuation kept; empty array for blank text."""
    tokens = F.split(F.lower(text), WHITESPACE)
    return F.filter(tokens, lambda w: w != "")


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def text_statistics(text: Column, tokens: Column | None = None) -> dict[str, Column]:
    """Length, words, diversity, complaints, punctuation and capitals of one text.

    Pass ``tokens`` when the words were already split into a column.
    """
    body = F.coalesce(text, F.lit(""))
    tokens = words(body) if tokens is None else tokens
    n_words = F.greatest(F.size(tokens), F.lit(1))
    complaints = F.array(*[F.lit(w) for w in specs.COMPLAINT_WORDS])
    upper = F.length(F.regexp_replace(body, r"[^\p{IsUppercase}]", ""))
    return {
        "review_length": F.length(body).cast("bigint"),
        "word_count": n_words.cast("bigint"),
        "lexical_diversity": F.size(F.array_distinct(tokens)) / n_words,
        "complaint_keyword_count": F.size(
            F.filter(tokens, lambda w: F.array_contains(complaints, w))
        ).cast("bigint"),
        "question_count": count_char(body, "?").cast("bigint"),
        "exclamation_count": count_char(body, "!").cast("bigint"),
        "caps_ratio": upper / F.greatest(F.length(body), F.lit(1)),
    }


def compose(summary: Column, text: Column, limit: int = 512) -> Column:
    """``summary. text`` cut to the encoder's input length."""
    body = F.coalesce(text, F.lit(""))
    joined = F.when(
        F.coalesce(summary, F.lit("")) != "", F.concat(summary, F.lit(". "), body)
    ).otherwise(body)
    return F.substring(joined, 1, limit)


def lexicon_polarity(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """(positive - negative words) / words, 0 for blank text."""
    tokens = words(F.coalesce(text, F.lit("")))
    pos = F.array(*[F.lit(w) for w in positive])
    neg = F.array(*[F.lit(w) for w in negative])
    balance = F.size(F.filter(tokens, lambda w: F.array_contains(pos, w))) - F.size(
        F.filter(tokens, lambda w: F.array_contains(neg, w))
    )
    return balance / F.greatest(F.size(tokens), F.lit(1))
