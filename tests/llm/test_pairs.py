"""The Jaccard join against a brute-force join, and its components."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ebbtide.llm import jaccard_join
from ebbtide.llm.components import components


def brute(rows, width, num, den):
    sets = {}
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        grams = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else set()
        sets[r[0]] = frozenset(grams) if grams or not words else frozenset([tuple(words)])
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_components_are_those_of_all_pairs(docs, rows, width, num, den, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)  # so that groups are cut into blocks
    members, links = jaccard_join.similar_documents(docs.filter("doc_id is not null"), width, num, den)
    own = [r for r in rows if r[0] is not None]
    expected = brute(own, width, num, den)
    found = members.collect()
    assert len(found) == len(own)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert links.count() <= len(own) * 4


def test_nulls_and_empty_tables(docs, none):
    members, links = jaccard_join.similar_documents(none)
    assert members.collect() == [] and links.collect() == []
    found = [r for r in jaccard_join.similar_documents(docs)[0].collect() if r["doc_id"] is None]
    assert len(found) == 2


def test_unit_links_need_every_order():
    """All pairs of a unit against set arithmetic, whatever the counts behind order one."""
    rng = random.Random(5)
    base = rng.sample(range(1 << 40), 120)
    sets = []
    for _ in range(60):
        own = set(base) - set(rng.sample(base, rng.randint(0, 20))) | set(rng.sample(range(1 << 40), rng.randint(0, 15)))
        sets.append(np.unique(np.array(list(own), dtype=np.uint64)))
    held = np.random.default_rng(1).integers(0, 50, jaccard_join.SLOTS)
    threshold = jaccard_join.Threshold(4, 5)
    root = list(range(60))
    for x, y in jaccard_join.unit_links(sets, threshold, held):
        common = len(np.intersect1d(sets[x], sets[y]))
        assert threshold.linked(common, len(sets[x]), len(sets[y]))
        a, b = root[x], root[y]
        assert a != b
        root = [a if r == b else r for r in root]
    for x in range(60):
        for y in range(x):
            common = len(np.intersect1d(sets[x], sets[y]))
            if threshold.linked(common, len(sets[x]), len(sets[y])):
                assert root[x] == root[y]


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_every_link_between_different_texts_is_returned(docs, rows, width, num, den, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    members, links = jaccard_join.similar_documents(docs.filter("doc_id is not null"), width, num, den)
    sets = {}
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        grams = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}
        if r[0] is not None and words:
            sets[r[0]] = frozenset(grams)
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    linked = {
        (a, b) for a in sets for b in sets
        if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    }
    nodes = set(first.values())
    found = [tuple(r) for r in links.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, b in linked if {a, b} <= nodes}
    n = {k: 0 for k in (r[0] for r in rows) if k is not None}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    counts = jaccard_join.link_counts(members, links).collect()
    assert len(counts) == members.count()
    assert {r["doc_id"]: r["n_links"] for r in counts} == n


def test_bands_never_part_linkable_sizes():
    for num, den in ((9, 10), (4, 5), (1, 2)):
        bands = jaccard_join.Threshold(num, den).bands()
        band = [sum(b <= n for b in bands[:60]) for n in range(1, 400)]
        for n in range(1, 400):
            for m in range(n, 400):
                if num * m <= den * n:
                    assert band[m - 1] - band[n - 1] <= 1


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(9, 8), (8, 9), (9, 9), (700, 499)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {found[k] for k in range(100, 161)} == {100}
    assert {found[k] for k in range(500, 700)} == {500}
    assert found[8] == found[9] == 8 and found[700] == 499
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
