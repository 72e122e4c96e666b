"""Token counts, fingerprints and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ebbtide.llm import fingerprints, quality_rules, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_counts_are_the_librarys(docs, rows, none):
    library = Tokenizer.from_file(PATH)
    expected = Counter(
        (r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows
    )
    result = token_counts.count_tokens(docs, PATH)
    assert Counter(map(tuple, result.collect())) == expected
    assert token_counts.count_tokens(none, PATH).collect() == []


@pytest.mark.parametrize("text", [
    "a" * 3000, "ab" * 999, "x  y", " lead", "trail ", "a\n\nb", "a \n b", "tab\tin", "tab \t in", "a  b", "　x",
    "<|endoftext|>", "a<|endoftext|> b", "don't we'll I'VE", "1234567890 ½ ²", "\x1c x\x85y", "é" * 50, "😀👩‍👩‍👧",
])
def test_odd_texts(text):
    counter = token_counts.Counter(PATH)
    expected = len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    assert counter([text, "other", text]) == [expected, counter(["other"])[0], expected]


def test_edited_texts_follow_the_next_document(docs, rows, none):
    found = fingerprints.fingerprint(docs, block_docs=20).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] not in (None, 35)}
    order = sorted((r for r in rows if r[0] is not None and r[0] != 35), key=lambda r: -r[0])
    for own, after in zip(order, order[1:], strict=False):
        if own[0] == 36:  # its next id occurs twice
            continue
        text, following = own[1] or "", after[1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        got = by_id[own[0]]
        assert got["n_chars"] == len(text)
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got["near_edited"] <= 1 and 0 <= got["near_next"] <= 1
    same = [by_id[r[0]]["fingerprint"] for r in rows if r[0] in by_id and r[1] == rows[40][1]]
    assert len(set(same)) == 1 and len(same) > 5
    assert by_id[order[-1][0]]["fingerprint"] != ""
    assert fingerprints.fingerprint(none).collect() == []


def test_wrap_around_and_single_document(spark):
    schema = "doc_id long, text string"
    one = fingerprints.fingerprint(spark.createDataFrame([(5, "abcdef")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    data = [(k, chr(97 + k) * 6) for k in range(26)]
    found = {r["doc_id"]: r for r in fingerprints.fingerprint(spark.createDataFrame(data, schema), block_docs=4).collect()}
    for k in range(26):
        expected = chr(97 + k) * 4 + chr(97 + (k - 1) % 26) * 2
        assert found[k]["edited_sha256"] == hashlib.sha256(expected.encode()).hexdigest()


def test_sketch_likeness_tracks_containment(spark):
    """Kept hashes of a long text and its first half: containment near 1; of unrelated texts near 0."""
    a = " ".join(f"w{k}" for k in range(4000))
    data = spark.createDataFrame([(2, a), (1, " ".join(a.split()[:2000])), (0, " ".join(f"v{k}" for k in range(3000)))], "doc_id long, text string")
    found = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprint(data).collect()}
    assert found[2] == 1.0 and found[1] == 0.0


def test_base_measures(docs, rows, none):
    found = quality_rules.judge(docs).collect()
    expected = Counter()
    for r in rows:
        text, own = r[1] or "", words(r[1])
        windows = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        covered = {k + j for k in range(len(own) - 4) if windows[tuple(own[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(own) < 10 or 100 * len(covered) > 20 * len(own)
        expected[
            r[0], len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed
        ] += 1
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in columns) for r in found) == expected
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality_rules.judge(none).collect() == []


def test_expectation_maximisation_finds_the_planted_rates():
    """Two kinds of documents, three rules against and one for them, drawn exactly in proportion."""
    import itertools

    share, against, for_ = 0.8, {True: 0.03, False: 0.6}, {True: 0.95, False: 0.05}
    patterns = []
    for votes in itertools.product((None, 0), (None, 0), (None, 0), (None, 1)):
        n = 0.0
        for good in (True, False):
            p = share if good else 1 - share
            for v in votes[:3]:
                p *= against[good] if v == 0 else 1 - against[good]
            p *= for_[good] if votes[3] == 1 else 1 - for_[good]
            n += p
        patterns.append((votes, n * 1e6))
    found, weights = quality_rules.fit(patterns, rounds=300)
    assert found == pytest.approx(share, abs=0.01)
    import math

    assert weights[0][0] == pytest.approx(math.log(0.03 / 0.6), abs=0.1)
    assert weights[3][1] == pytest.approx(math.log(0.95 / 0.05), abs=0.1)


def test_verdict_splits_junk_from_prose(spark):
    import random

    rng = random.Random(3)
    prose = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(80)) for _ in range(200)]
    shouted = [t.upper() for t in prose[:20]]
    signs = [t.replace(" ", "### ") for t in prose[20:40]]
    data = [(k, t) for k, t in enumerate([*prose, *shouted, *signs])]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(kept[k] for k in range(200)) and not any(kept[k] for k in range(200, 240))
