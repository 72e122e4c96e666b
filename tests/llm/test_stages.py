"""Stages on repeated rows and rows without an id, link counts, levels of long chains, sketches that merge."""

from __future__ import annotations

import json
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from ebbtide.llm import chat, common, fingerprints, jaccard_join, packing, quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_one_row_per_id(spark, docs, rows, monkeypatch):
    for limit in (common.BROADCAST_IDS, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", limit)
        repeated = docs.union(docs.filter("doc_id % 3 = 0"))
        found = [tuple(r) for r in common.one_row_per_id(repeated).collect()]
        assert Counter(found) == Counter(r for r in rows if r[0] is None) + Counter({r for r in rows if r[0] is not None})


def test_near_duplicate_stage_leaves_one_row_of_each_group(spark, docs, rows):
    every = docs.union(docs.filter("doc_id < 60"))
    kept = corpus_pipeline.near_duplicate_stage(spark, every, "").collect()
    members = jaccard_join.similar_documents(docs)[0].collect()
    component = {r["doc_id"]: r["component_id"] for r in members}
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted(set(component.values()) - {None})
    assert sum(r["doc_id"] is None for r in kept) == sum(r[0] is None for r in rows)


def test_every_row_is_judged(spark, docs, labels):
    """Rows of one id or without an id stay or go by their own verdicts."""
    junk = [(None, "#### $$$$ " * 40, "en", "s1", 1, 1, 2, "x", "y"), (3, "#### $$$$ " * 40, "en", "s1", 1, 1, 2, "x", "y")]
    every = docs.union(spark.createDataFrame(junk, docs.schema))
    judged = quality.score(every, labels)
    assert "row_key" not in judged.columns
    kept = Counter(r["doc_id"] for r in judged.filter("keep").collect())
    assert Counter(r["doc_id"] for r in quality.accepted(every, labels).collect()) == kept
    strict = quality.accepted(every, labels, threshold=1.1)
    assert strict.collect() == [] and quality.accepted(every, labels, threshold=-1.0).count() == every.count()


def test_what_is_taken_of_one_document_shares_no_bin(spark, docs):
    taken = docs.union(docs.withColumn("text", F.substring("text", 1, 40)))
    found = corpus_pipeline.packing_stage(spark, taken, "").collect()
    bins = defaultdict(list)
    for r in found:
        bins[r["shard"], r["bin"]].append(r["doc_id"])
    assert all(len({d for d in own if d is not None}) == sum(d is not None for d in own) for own in bins.values())
    assert found and set(packing.SCHEMA.replace(",", "").split()[::2]) == set(found[0].asDict())


def test_link_counts_come_with_the_members(docs):
    members, links = jaccard_join.similar_documents(docs, 3, 9, 10)
    alone = {(r["doc_id"], r["n_links"]) for r in jaccard_join.link_counts(members, links).collect()}
    both = jaccard_join.counted_documents(docs, 3, 9, 10).collect()
    assert {(r["doc_id"], r["n_links"]) for r in both} == alone
    assert Counter((r["doc_id"], r["component_id"]) for r in both) == Counter((r["doc_id"], r["component_id"]) for r in members.collect())


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"


def plain_levels(calls):
    """Longest way to a call without dependencies; None on or after a cycle."""
    deps = {c[2]: [d for d in c[5] if d in {x[2] for x in calls}] for c in calls}
    levels = {}
    while True:
        ready = [c for c in deps if c not in levels and all(d in levels for d in deps[c])]
        if not ready:
            return {c: levels.get(c) for c in deps}
        levels |= {c: max((levels[d] + 1 for d in deps[c]), default=0) for c in ready}


def test_levels_of_any_graph(spark):
    rng = random.Random(3)
    calls = []
    for conv in range(6):
        own = []
        for k in range(40):
            deps = rng.sample([f"c{x}" for x in range(k)], min(k, rng.choice([0, 1, 1, 1, 2, 3])))
            own.append((conv, k, f"c{k}", "search", "{}", deps + (["none"] if k % 9 == 0 else [])))
        if conv == 5:
            own[10] = (conv, 10, "c10", "search", "{}", ["c20"])
            own[20] = (conv, 20, "c20", "search", "{}", ["c10"])
        calls += own
    found = {(r["conv_id"], r["call_id"]): r["level"] for r in chat.topological_levels(spark.createDataFrame(calls, CALLS)).collect()}
    for conv in range(6):
        expected = plain_levels([c for c in calls if c[0] == conv])
        assert {c: found.get((conv, c)) for c in expected} == expected


def test_a_long_chain_and_a_long_turn(spark):
    calls = [(1, k, f"c{k}", "search", '{"limit":1,"query":"q"}', [f"c{k - 1}"] if k else []) for k in range(500)]
    levels = chat.topological_levels(spark.createDataFrame(calls, CALLS)).collect()
    assert {r["call_id"]: r["level"] for r in levels} == {f"c{k}": k for k in range(500)}
    text = " ".join(f'w{k}"' for k in range(2000))
    turns = spark.createDataFrame([(7, 0, "user", text), (7, 1, "assistant", "ok"), (7, 2, "user", text)], "conv_id long, turn long, role string, text string")
    (row,) = chat.link_tool_calls(*chat.calls_of_turns(turns)).collect()
    message = json.loads(row["message"])
    assert message["arguments"].get("query") == text and message["result"] == text


def test_sketches_merge(spark, docs):
    """The sketch of two texts' shingles is the union of their sketches, also where nothing is kept."""
    texts = docs.filter("doc_id is not null and text is not null")
    for one_in in (4, 500):
        both = texts.select("doc_id", "text", fingerprints.sketch(F.col("text"), 1, one_in).alias("s"))
        pairs = both.alias("a").join(both.alias("b"), F.col("a.doc_id") + 7 == F.col("b.doc_id"))
        found = pairs.select(
            fingerprints.merge(F.col("a.s.kept"), F.col("b.s.kept")).alias("merged"),
            fingerprints.sketch(F.concat_ws(" ", "a.text", "b.text"), 1, one_in)["kept"].alias("own"),
        ).collect()
        assert len(found) > 100 and all(r["merged"] == r["own"] for r in found)
        assert any(r["own"] for r in found) and any(not r["own"] for r in found) == (one_in == 500)
