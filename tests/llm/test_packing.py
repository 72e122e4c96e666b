"""Mixing and packing: limits, targets and conflicts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from ebbtide.llm import mixing, packing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_are_capped_and_reshared():
    sizes, weights = [100, 10, 1000, 50], [3, 1, 2, 3]
    found = mixing.targets(sizes, weights)
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * n for t, n in zip(found, sizes, strict=True))
    free = [(t / w) for t, n, w in zip(found, sizes, weights, strict=True) if t < 2 * n]
    assert len(set(free)) <= 1
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]


def test_the_mix_meets_targets_and_limits(docs, rows, none):
    found = mixing.mixed_sizes(docs, block=16)
    first, again = found.collect(), mixing.mixed_sizes(docs.repartition(5), block=16).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    assert Counter((r["doc_id"], r["size"]) for r in first) == Counter((r[0], n_words(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += n_words(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names], [3, 1, 2, 3][: len(names)]), strict=True))
    taken = Counter()
    for r in first:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == wanted[r["source"]]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - wanted[s]) <= 32
    assert mixing.mixed_sizes(none).collect() == []


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        found = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1)).alias("k")).collect()
        assert sorted(r["k"] for r in found) == list(range(n))
    assert [r["k"] for r in found] != list(range(100))


def test_shards_draw_about_their_share(spark):
    plan = mixing.Plan(["a", "b"], [1000, 1000], [0, 0], [4000, 3000], [6000, 2000])
    slots = mixing.draw_slots(spark, plan, shard_slots=1000).collect()
    per_source = Counter(r["s"] for r in slots)
    assert per_source == {0: 6000, 1: 2000}
    per_shard = Counter((r["shard"], r["s"]) for r in slots)
    assert all(600 < per_shard[k, 0] < 900 for k in range(8)) and len({per_shard[k, 0] for k in range(8)}) > 1
    uses = Counter((r["s"], r["block"]) for r in slots)
    assert max(uses.values()) <= 2 and len({b for s, b in uses if s == 0}) == 4000
    assert len({b for s, b in uses if s == 1}) == 2000  # within one epoch, no block twice


def test_mixed_texts_hold_the_words_taken(docs, rows, none):
    taken = Counter()
    for r in mixing.mixed_sizes(docs, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    unique = docs.dropDuplicates(["doc_id", "text"])
    found = mixing.mixed_texts(unique, block=16)
    assert found.columns == docs.columns
    sums = Counter()
    originals = defaultdict(set)
    for r in rows:
        originals[r[0]].update((r[1] or "").split())
    for r in found.collect():
        sums[r["doc_id"]] += n_words(r["text"])
        assert r["n_chars"] == len(r["text"])
        assert set(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) <= {w for t in [x[1] or "" for x in rows if x[0] == r["doc_id"]] for w in re.findall(r"[^\x20\x09-\x0D]+", t)}
    assert sums == Counter({r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(unique, block=16).collect() if r["taken"]})
    assert mixing.mixed_texts(none).collect() == []


def test_mixed_texts_take_repeated_rows_once_each(spark, docs, rows):
    """Repeated rows, and rows without an id of one size and source, take their own words only."""
    odd = [(None, f"{c} {c}x {c}y", "en", "s1", 7, 1, 2, "x", "y") for c in "abc"] + [rows[5]] * 4
    every = docs.union(spark.createDataFrame(odd, docs.schema))
    taken, found = Counter(), Counter()
    for r in mixing.mixed_sizes(every, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    texts = Counter()
    for r in mixing.mixed_texts(every, block=16).collect():
        found[r["doc_id"]] += n_words(r["text"])
        if r["doc_id"] is None:
            texts.update(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert found == +taken
    assert texts and max(texts.values()) <= 2


def test_bins_hold_no_conflict_and_lose_nothing(docs, rows, none):
    found = packing.pack(docs, capacity=256, per_source=3, shard_pieces=40).collect()
    assert sum(r["n_words"] for r in found) == sum(n_words(r[1]) for r in rows)
    bins = defaultdict(list)
    for r in found:
        bins[r["shard"], r["bin"]].append(r)
    assert len({k[0] for k in bins}) > 1
    for own in bins.values():
        assert sum(r["n_words"] for r in own) == own[0]["bin_words"] <= 256
        assert len({r["cluster"] for r in own}) == len(own)
        assert max(Counter(r["source"] for r in own).values()) <= 3
    assert packing.pack(none).collect() == []


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    """Every piece looks at all bins."""
    bins = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fitting = [
            (b["left"], k) for k, b in enumerate(bins)
            if b["left"] >= size and b["left"] > 0 and cluster not in b["clusters"] and b["sources"][source] < per_source
        ]
        if fitting:
            k = min(fitting)[1]
        else:
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
            k = len(bins) - 1
        bins[k]["left"] -= size
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"][source] += 1
        placed.append(k)
    return placed


def test_best_fit_is_the_tightest_compatible_bin():
    import random

    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    sources = [rng.choice([0, 0, 1, 2, 3]) for _ in sizes]
    clusters = [rng.choice([*[7] * 60, *range(100, 400)]) for _ in sizes]
    got = packing.best_fit(sizes, [1 << s for s in sources], [1 << c for c in clusters], 100, 3)
    assert got == plain_best_fit(sizes, sources, clusters, 100, 3)
