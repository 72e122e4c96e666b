"""Ranked lexical search against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from ebbtide.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(rows, items, k=10):
    docs = [(r[0], Counter(t := terms(r[1])), len(t)) for r in rows if terms(r[1])]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    found = set()
    least = {}
    for item, text in items:
        if text is not None:
            least[item] = min(text, least.get(item, text))
    for item, text in least.items():
        scored = []
        for doc, own, n in docs:
            m, score = 25 + 75 * n * n_docs // n_terms, 0
            for t in terms(text):
                if own[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * own[t] // (1000 * own[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        found |= {(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:k], 1)}
    return found


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows]
    return [
        (0, " ".join(texts[0].split()[:40])), (1, texts[40]), (2, "Éa b ÇA 😀 x one two one"), (3, None), (4, "... !"), (5, "zzz unknown"),
        (6, "w"), (None, texts[50]), (7, texts[60] + " again"), (7, texts[60]), (8, " ".join(texts[33].split()[::-1])), (8, None),
    ]


@pytest.mark.parametrize("block", [(1 << 17, 4096), (60, 3)])
def test_ranks_are_those_of_all_documents(spark, docs, rows, items, block):
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = lexical_search.search(docs, asked, block_terms=block[0], block_items=block[1])
    got = found.collect()
    assert {tuple(r) for r in got} == brute(rows, items) and len(got) == len(set(got))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_few_items_at_once_and_small_steps(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "STEP_ITEMS", 2)
    monkeypatch.setattr(lexical_search, "STEP_CELLS", 50)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in lexical_search.search(docs, asked, k=3).collect()} == brute(rows, items, 3)


def test_equal_scores_come_by_id_across_classes(spark):
    """Classes of one score interleave by document; copies expand in order."""
    texts = ["apple pear fig", "pear apple fig", "apple pear date"]
    rows = [(100 - k, texts[k % 3]) for k in range(40)] + [(5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "Apple"), (2, "apple apple date")]
    found = {tuple(r) for r in lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute(rows, items)
    assert sorted(r[2] for r in found if r[0] == 1) == list(range(61, 71))


def test_colliding_hashes_are_told_apart(spark, docs, rows, items, monkeypatch):
    """With one hash for all, classes are still told apart by their bags."""
    from pyspark.sql import functions as F

    class Constant:
        def __getattr__(self, name):
            return (lambda *columns: F.lit(7).cast("long")) if name == "xxhash64" else getattr(F, name)

    monkeypatch.setattr(lexical_search, "F", Constant())
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in lexical_search.search(docs, asked).collect()} == brute(rows, items)


def test_empty_tables(spark, docs, none):
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    for found in (lexical_search.search(none, some), lexical_search.search(docs, no_items), lexical_search.search(none, no_items)):
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
