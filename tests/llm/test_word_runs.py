"""Periodic runs of words against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import word_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, least=12):
    """(start, length, period) by comparing all words that are p apart, for every p."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        same = [w[i] == w[i + p] for i in range(len(w) - p)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def check(sequences, least):
    runs, texts = word_runs.text_runs([" ".join(w).encode() for w in sequences], least)
    for w, own, text in zip(sequences, runs, texts, strict=True):
        expected = plain_runs(w, least)
        assert sorted(map(tuple, own.tolist())) == expected
        assert text.decode() == collapsed(w, expected)


pieces = st.lists(
    st.tuples(st.text("abc", min_size=1, max_size=5), st.integers(1, 25), st.integers(0, 4)), min_size=1, max_size=6
).map(lambda parts: [x for unit, times, more in parts for x in unit * times + unit[:more]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from("ab"), max_size=120), pieces), min_size=1, max_size=5), st.sampled_from([4, 12]))
def test_all_runs_of_repetitive_sequences(sequences, least):
    check(sequences, least)


def test_powers_of_small_periods_beside_each_other():
    """Squares across neighbouring regions of one small period hold no synchronising position."""
    for unit in ("ab", "abc", "abcde"):
        for first in range(60, 70):
            check([list((unit * 80)[:first] + (unit * 80)[: 130 - first] + "x")], 12)


def test_fibonacci_words_and_one_word():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    check([list(b), ["w"] * 3000, list("abcd" * 300), []], 12)


def test_synchronising_sets_are_consistent_and_dense():
    rng = np.random.default_rng(4)
    codes = np.r_[rng.integers(0, 2, 600), 2]
    blocks = word_runs.Blocks(codes, [601] * 6)
    for k in (1, 2, 3, 4):
        scale = 1 << k
        level = blocks.levels[k]
        at = set(word_runs.synchronising(level, scale, np.zeros(len(level), dtype=bool)).tolist())
        seen = {}
        for i in range(600 - 2 * scale):
            assert seen.setdefault(codes[i : i + 2 * scale].tobytes(), i in at) == (i in at)
            assert any(j in at for j in range(i, i + scale)) or i + 3 * scale > 600


def expected_row(doc_id, w):
    runs = plain_runs(w)
    longest = min(((-n, s, p) for s, n, p in runs), default=None)
    best = (None,) * 4 if longest is None else (longest[1], -longest[0], longest[2], 1000 * -longest[0] // longest[2])
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(w, runs)))


def test_digests_of_documents(spark, docs, rows, none):
    query = lambda d: word_runs.digests(word_runs.periodic_runs(word_runs.with_planted_runs(d)))
    extra = [(k, " ".join(f"{c}{k}" for c in "abcdefghijkl" * 9)) for k in range(1000, 1060)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    short = [r for r in [(r[0], r[1]) for r in rows] + extra if len(words(r[1])) < 2000]
    found = [tuple(r) for r in query(every).collect()]
    assert len(found) == len(rows) + len(extra)
    skipped = {r[0] for r in rows if len(words(r[1])) >= 2000}
    assert Counter(r for r in found if r[0] not in skipped) == Counter(expected_row(d, planted(d, words(t))) for d, t in short)
    assert any(r[1] for r in found if r[0] is not None and r[0] >= 1000)
    assert query(none).collect() == []


def test_very_long_text_of_one_period(spark):
    text = " ".join(f"w{k % 4099}" for k in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in word_runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(0, 50_000, 4099)]
    assert found[1]["collapsed"] == " ".join(f"w{k}" for k in range(4099))
    assert found[2]["runs"] == [] and found[2]["collapsed"] == "a b" and found[3]["collapsed"] == ""
