"""Packing by minimum bin slack: subset sums, ids of the library, whole sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm import slack_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=7), st.integers(1, 70))
def test_least_slack_is_the_least(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    best = max(s for s in sums if s <= capacity)
    for choose in (slack_packing.fullest, slack_packing.least_slack):
        chosen = choose(sorted(counts), counts, capacity)
        assert sum(length * n for length, n in chosen.items()) == best
        assert all(0 < n <= counts[length] for length, n in chosen.items())


def test_ids_are_the_librarys(library):
    rng = random.Random(5)
    parts = [
        "a", "B", "é", "é", "́", "İ", "Σ", "ς", "ß", "'s", "'T", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "\n",
        "\t", "\x0b", "\r", "\x1c", "\x85", "\xa0", "　", "1", "½", ".", ",", "...", "!", "😀", "中", "한", "\x00", "Word.", "été,",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    ids = slack_packing.WordIds(PATH)
    got = [x for k in range(0, 4000, 100) for x in ids([t.encode() for t in texts[k : k + 100]])]
    for text, own in zip(texts, got, strict=True):
        assert np.frombuffer(own, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def whole(found, capacity):
    """Documents put together again; every sequence is gapless and needs no padding."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], bytes(r["ids"])))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return sequences, documents


@pytest.mark.parametrize("capacity, pool", [(2048, 1 << 21), (128, 3000), (64, 100)])
def test_every_id_lies_in_one_piece(docs, rows, library, capacity, pool):
    found = slack_packing.pack(docs, PATH, capacity=capacity, pool_ids=pool).collect()
    sequences, documents = whole(found, capacity)
    expected = Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        expected[r[0], len(ids), np.array(ids, "<u4").tobytes()] += 1
    copies = Counter((r[0], r[1]) for r in rows)
    for (doc, n), pieces in documents.items():
        if doc is not None and max(c for (d, _), c in copies.items() if d == doc) == 1:
            pieces.sort()
            assert [s for s, _, _ in pieces] == np.cumsum([0, *(x for _, x, _ in pieces)])[:-1].tolist()
            assert expected[doc, n, b"".join(p for _, _, p in pieces)] == 1
    assert sum(r["length"] for r in found) == sum(n * c for (_, n, _), c in expected.items())
    short = [s for s in sequences.values() if sum(x for _, x in s) < capacity]
    assert len(short) <= 3 * capacity.bit_length()  # a few at the end of each partition


def test_pieces_are_cut_only_where_nothing_fits(spark):
    """Lengths that fill windows exactly are never cut."""
    rows = [(k, " ".join(["a"] * (n - 1))) for k, n in enumerate([10, 6, 9, 7, 8, 8, 16, 12, 4] * 4)]
    found = slack_packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, capacity=16).collect()
    assert all(r["length"] == r["doc_tokens"] for r in found) and len(found) == len(rows)
    equal = spark.createDataFrame([(k, "a a") for k in range(50)], "doc_id long, text string").coalesce(1)
    sequences, _ = whole(slack_packing.pack(equal, PATH, capacity=16).collect(), 16)
    assert len(sequences) == 9 + 2  # 150 ids: nine windows, 4 and 2


def test_digests_and_empty_table(docs, none):
    pieces = slack_packing.pack(docs, PATH).collect()
    digests = slack_packing.digests(slack_packing.pack(docs, PATH)).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in digests) == Counter(
        (r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in pieces
    )
    assert [r for r in digests if r["doc_id"] is None and r["doc_tokens"] == 1]
    assert slack_packing.pack(none, PATH).collect() == []
