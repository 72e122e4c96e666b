"""Quality and toxicity models, tool calls, licences and the pipeline."""

from __future__ import annotations

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import chat, licenses, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    def read(name):
        return spark.read.parquet(f"{SF}/{name}.parquet")

    return read


def halves(labels):
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return labels.filter(side == 0), labels.filter(side == 1)


def test_quality_on_held_out_labels(tables):
    train, test = halves(tables("labels"))
    scored = quality.score(tables("documents"), train).join(test, "doc_id").collect()
    right = sum(r["keep"] == bool(r["quality"]) for r in scored) / len(scored)
    kept = [r["keep"] for r in scored if r["quality"] == 1]
    assert right > 0.95 and sum(kept) / len(kept) > 0.97


def test_sparse_sites_shrink(spark):
    """A host of one bad document keeps a share near the global one; a host of many doesn't."""
    good, bad = " ".join(f"word{k}" for k in range(60)), "BAD!! " * 40
    rows = [(k, f"{good} x{k}", "en", "large") for k in range(300)] + [(1000 + k, bad, "en", "poor") for k in range(200)]
    rows += [(5000, bad, "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[3] == "large")) for r in rows if r[0] % 2 == 0 and r[0] < 5000], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert found[2]["host_share"] > 0.9 and found[1000]["host_share"] < 0.1
    assert 0.4 < found[5000]["host_share"] < 0.8  # only its own document, which is left out
    assert found[2]["keep"] and not found[1000]["keep"]


def test_quality_of_odd_rows(docs, rows, labels, none):
    found = quality.score(docs, labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert all(0 <= r["posterior"] <= 1 for r in found)
    unlabelled = quality.score(docs, labels.filter("quality > 5")).collect()
    assert {r["evidence"] for r in unlabelled} == {0.0}
    assert quality.score(none, labels).collect() == []
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns


def test_addresses_have_host_and_section(spark):
    data = spark.createDataFrame([("https://blog.a.example/en/71#top",), ("http://b.example",), (None,)], "url string")
    found = data.select(*quality.pages_site(F.col("url"))).collect()
    assert list(map(tuple, found)) == [("blog.a.example", "en"), ("b.example", ""), (None, None)]


def test_ordinal_fit_recovers_planted_thresholds():
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.random((n, 2)) < 0.4
    score = x @ np.array([2.0, 4.0])
    latent = score + rng.logistic(size=n)
    grade = np.searchsorted([1.0, 3.0, 5.0], latent)
    row, column = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(row, column, np.ones(len(row)), grade, 2, ridge=0.0, rounds=2000)
    assert weights == pytest.approx([2.0, 4.0], abs=0.3)
    assert cuts == pytest.approx([1.0, 3.0, 5.0], abs=0.3)


def test_ordinal_gradient_is_that_of_the_likelihood():
    """Brute force: no small change of the fitted parameters makes the grades more likely."""
    rng = np.random.default_rng(1)
    x = (rng.random((300, 3)) < 0.5).astype(float)
    grade = np.searchsorted([0.5, 1.5, 2.5], x @ np.array([1.0, 2.0, -1.0]) + rng.logistic(size=300))
    row, column = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(row, column, np.ones(len(row)), grade, 3, ridge=0.0, rounds=4000, rate=0.02)

    def likelihood(w, c):
        edge = np.r_[-np.inf, c, np.inf]
        s = x @ w
        return np.log(toxicity._sigmoid(edge[grade + 1] - s) - toxicity._sigmoid(edge[grade] - s)).mean()

    best = likelihood(weights, cuts)
    for k in range(3):
        for step in (-0.05, 0.05):
            assert likelihood(weights + step * np.eye(3)[k], cuts) <= best + 1e-6
            assert likelihood(weights, cuts + step * np.eye(3)[k]) <= best + 1e-6


def test_toxic_documents_of_held_out_labels(spark):
    """Severity grows with the number of planted words, and clean documents are left alone."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for k in range(600):
        own = rng.choices(vocabulary, k=rng.randint(5, 200))
        bad = rng.randint(1, 8) if k % 5 == 0 else 0
        for word in rng.sample(["zzidiot", "zzmoron", "zzscum", "zztrash", "zzloser", "zzfool", "zzclod", "zzoaf"], bad):
            own.insert(rng.randrange(len(own)), word + rng.choice(["", ".", ","]))
        rows.append((k, " ".join(own), bad))
        labels.append((k, int(bad > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad int")
    model = toxicity.train(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert not any(found[k]["toxic"] for k, _, bad in rows[400:] if not bad)
    assert sum(found[k]["toxic"] for k, _, bad in rows[400:] if bad) >= 38  # of 40
    assert all(r["p_1"] >= r["p_2"] >= r["p_3"] for r in found.values())
    severity = [np.mean([found[k]["expected_severity"] for k, _, b in rows[400:] if low <= b <= high]) for low, high in ((0, 0), (1, 2), (6, 8))]
    assert severity[0] < severity[1] < severity[2]
    assert toxicity.clean(docs, model).count() == sum(not r["toxic"] for r in found.values())


def test_toxicity_of_odd_rows(docs, rows, labels, none):
    model = toxicity.train(docs, labels)
    assert Counter(r["doc_id"] for r in toxicity.grade(docs, model).collect()) == Counter(r[0] for r in rows)
    blank = toxicity.train(docs, labels.filter("toxic = 0"))
    assert not any(r["toxic"] for r in toxicity.grade(docs, blank).collect())
    assert toxicity.grade(none, model).collect() == [] and toxicity.clean(none, blank).collect() == []


def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame([
        (1, 5, "a", "search", '{"query": "x", "limit": 3}', ["b"]),
        (1, 6, "b", "lookup", '{"query": "é\\"\\n", "zeta": 1}', ["c", "gone"]),
        (1, 7, "c", "calculate", '{"limit": "3"}', []),
        (1, 8, "d", "calculate", "[1]", ["e"]),
        (1, 9, "e", "nothing", "{}", ["d"]),
        (2, 1, "a", "search", None, None),
        (2, 2, None, "search", "{not json", ["a"]),
        (1, 7, "c", "calculate", '{"limit": "3"}', []),
    ], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", "two"), (1, "a", "one"), (1, "z", "orphan"), (2, None, "no")], "conv_id long, call_id string, content string")
    found = {(r["conv_id"], r["call_id"]): r for r in chat.link_tool_calls(calls, results).collect()}
    assert len(found) == 7
    assert {k[1]: r["level"] for k, r in found.items() if k[0] == 1} == {"a": 2, "b": 1, "c": 0, "d": None, "e": None}
    assert found[1, "a"]["linked"] and not found[1, "b"]["linked"] and not found[2, None]["linked"]
    assert found[1, "a"]["valid"] and found[1, "b"]["errors"] == "unknown argument"
    assert found[1, "c"]["errors"] == "type of limit" and found[1, "d"]["errors"] == "no object"
    assert found[1, "e"]["errors"] == "unknown tool" and found[2, "a"]["errors"] == found[2, None]["errors"] == "no object"
    message = found[1, "b"]["message"]
    parsed = json.loads(message)
    assert parsed["arguments"] == {"query": 'é"\n', "zeta": 1}
    assert message == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(found[1, "a"]["message"])["result"] == "one"


def test_calls_of_odd_turns(spark, tables):
    turns = tables("conversations")
    schema = "conv_id long, turn long, role string, text string, level int"
    odd = spark.createDataFrame([(1, 0, "user", None, 1), (1, 1, "assistant", "", 1), (1, 2, "user", "x", 1), (None, None, None, None, 1), (1, 1, "assistant", "", 1)], schema)
    found = chat.link_tool_calls(*chat.calls_of_turns(odd)).collect()
    assert [(r["call_id"], r["linked"]) for r in found] == [("call-1-1", True)]
    assert chat.link_tool_calls(*chat.calls_of_turns(odd.limit(0))).collect() == []
    calls = turns.filter("role = 'assistant'").count()
    whole = chat.link_tool_calls(*chat.calls_of_turns(turns)).collect()
    assert len(whole) == calls
    for r in whole:
        parsed = json.loads(r["message"])
        assert r["message"] == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def plain_scan(data, paths, least):
    """Best (similarity, line, licence) of each text by dictionaries: lines, windows on the rarest distinctive terms, licence files."""
    import math
    import re

    def terms(text):
        return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]

    known = licenses.numbered(licenses.TEMPLATES, licenses.BODIES)
    held = Counter(t for text in data for t in set(terms(text or "")))

    def unit(words):
        own = {t: c * licenses.inverse_frequency(held[t], len(data)) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in own.values())) or 1.0
        return {t: w / norm for t, w in own.items()}

    vectors = [unit(x.terms) for x in known]
    laid = []
    for x, own in zip(known, vectors, strict=True):
        marks = sorted((held[t], t) for t in licenses.distinctive(own, least) if held[t])[: licenses.SEEDS]
        laid.append([] if x.body else [(t, j) for _, t in marks for j, other in enumerate(x.terms) if other == t])
    found = []
    for text, path in zip(data, paths, strict=True):
        words = [(k, t) for k, line in enumerate((text or "").split("\n")) for t in terms(line)]
        tried = []
        for k, line in enumerate((text or "").split("\n")):
            tried += [(k, terms(line), n) for n, x in enumerate(known) if not x.body]
        if re.search(licenses.FILE_NAME, path):
            tried += [(0, [t for _, t in words], n) for n in range(len(known))]
        for n, x in enumerate(known):
            for at in {i - j for t, j in laid[n] for i, (_, w) in enumerate(words) if w == t}:
                window = words[max(at, 0) : at + len(x.terms)]
                tried.append((window[0][0], [t for _, t in window], n))
        best = None
        for line, candidate, n in tried:
            likeness = sum(w * vectors[n].get(t, 0) for t, w in unit(candidate).items())
            if likeness >= least:
                key = (-round(likeness, 6), line, known[n].license)
                best = min(best or key, key)
        found.append(best)
    return found


def test_licences_are_those_of_a_plain_scan(spark, tables):
    texts = [r["text"] for r in tables("documents").orderBy("doc_id").select("text").collect()]
    prose = " ".join(f"w{k % 97}" for k in range(30_000))
    texts += [
        None, "", "foo\nLICENSED UNDER THE APACHE LICENSE version 2.0, or so", "MIT", "Released under the MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nReleased under the MIT License.",
        "Released under the MIT License.\n" * 2,
    ]
    paths = [f"d/{k}.txt" if k % 5 else f"d/LICENSE-{k}" for k in range(len(texts))]
    odd = {  # wrapped over lines, inside a long line, cut off at the start, whole bodies in a licence file and elsewhere
        "w/a.txt": "x\nThis work is licensed under the\nGNU General Public\nLicense, version 3.", "w/b.txt": f"{prose} Released under the MIT License. {prose}",
        "w/c.txt": "licensed under the GNU General Public License, version 3", "w/LICENSE": licenses.BODIES["Zlib"][0].replace(" ", "\n"),
        "w/zlib.txt": licenses.BODIES["Zlib"][0], "w/COPYING": licenses.BODIES["MIT"][0] + " Copyright 2001 by somebody",
    }
    texts, paths = texts + list(odd.values()), paths + list(odd)
    docs = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(zip(texts, paths, strict=True))], "doc_id long, text string, path string")
    rows = licenses.scan(docs).collect()
    found = {r["doc_id"]: (-round(r["similarity"], 6), r["line"], r["own_license"]) for r in rows}
    expected = {k: v for k, v in enumerate(plain_scan(texts, paths, licenses.LEAST)) if v}
    assert len(expected) > 30 and found == expected
    named = {r["path"]: r["own_license"] for r in rows}
    assert [named.get(p) for p in odd] == ["GPL-3.0", "MIT", "GPL-3.0", "Zlib", None, "MIT"]


def test_a_line_has_its_licence_in_any_corpus(spark):
    """Words that many documents hold weigh little, however many documents there are."""
    line = "Released under the MIT License and of the last"
    few = [(k, "and of the last", f"{k}.txt") for k in range(10)] + [(1000, line, "x.txt")]
    many = [(k, "and of the last", f"{k}.txt") for k in range(1000)] + [(1000, line, "x.txt")]
    for rows in (few, many):
        found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
        assert [(r["doc_id"], r["own_license"]) for r in found] == [(1000, "MIT")]


def test_licences_of_odd_rows(docs, none):
    placed = docs.withColumn("path", F.concat(F.lit("a/LICENSE"), F.col("doc_id").cast("string"))).withColumn("term", F.lit(1))
    assert Counter(r["doc_id"] for r in licenses.licenses(placed).collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert licenses.licenses(placed.limit(0)).collect() == []


def test_nearest_directory_is_inherited(spark, none):
    mit, gpl = "Released under the MIT License.", "x\nThis work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "plain"), (3, "a/b/LICENSE.txt", gpl), (4, "a/b/c/y.txt", mit), (5, "a/z.txt", None),
        (6, "other/z.txt", "plain"), (7, None, "plain"), (8, "top.txt", ""), (9, "a/b/COPYING", gpl), (10, "a/b/NOTICE", mit), (2, "a/b/c/x.txt", "plain"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    found = [(r["doc_id"], r["license"], r["origin"], r["from_dir"]) for r in licenses.licenses(docs).collect()]
    assert Counter(found) == Counter([
        (1, "MIT", "header", None), (2, "GPL-3.0", "inherited", "a/b"), (2, "GPL-3.0", "inherited", "a/b"), (3, "GPL-3.0", "header", None),
        (4, "MIT", "header", None), (5, "MIT", "inherited", "a"), (6, None, "none", None), (7, None, "none", None), (8, None, "none", None),
        (9, "GPL-3.0", "header", None), (10, "MIT", "header", None),
    ])
    assert licenses.licenses(docs.limit(0)).collect() == []


def test_pipeline_stages_take_effect(spark, tables):
    import corpus_pipeline
    from ebbtide.llm import packing
    from ebbtide.llm.common import stored

    docs = tables("documents")
    labels = {r["doc_id"]: r for r in tables("labels").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), name))
    for before, after in zip(kept, kept[1:-1], strict=False):
        assert after.columns == docs.columns
        assert not after.select("doc_id").distinct().join(before, "doc_id", "left_anti").head(1)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert sum(labels[i]["quality"] == 0 for i in ids[1] & set(labels)) <= 2
    assert sum(labels[i]["quality"] == 1 for i in (ids[0] - ids[1]) & set(labels)) <= 5
    assert sum(labels[i]["toxic"] == 0 for i in (ids[1] - ids[2]) & set(labels)) == 0
    texts = {r["doc_id"]: frozenset(g for g in zip(*[r["text"].lower().split()[k:] for k in range(5)], strict=False)) for r in kept[3].collect()}
    own = sorted(texts.items())
    for k, (i, a) in enumerate(own):
        for j, b in own[k + 1 :]:
            if a and b and 0.8 * len(a) <= len(b) <= len(a) / 0.8:
                common = len(a & b)
                assert 5 * common < 4 * (len(a) + len(b) - common), (i, j)
    packed = kept[-1].collect()
    words = kept[-2].select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(sum(r["n_words"] for r in packed) - words) <= 0.001 * words
    assert max(r["bin_words"] for r in packed) <= packing.CAPACITY
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert run.count() > 0


def test_stages_take_odd_rows_and_empty_tables(spark, docs, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == [], name
        out = stage(spark, docs, SF)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns, name
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.filter("doc_id is null").count() == 2


def test_calls_without_a_key_keep_their_rows(spark):
    calls = spark.createDataFrame([
        (1, 1, None, "search", '{"query": "x", "limit": 3}', ["a"]),
        (1, 2, None, "lookup", '{"query": "y"}', None),
        (None, 3, "a", "search", '{"query": "z", "limit": 1}', None),
        (None, 4, "a", "lookup", '{"query": "w"}', None),
        (1, 5, "a", "lookup", '{"query": "v"}', None),
        (1, 5, "a", "lookup", '{"query": "v"}', None),
    ], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, None, "r"), (None, "a", "r"), (1, "a", "r")], "conv_id long, call_id string, content string")
    found = sorted((r["turn"], r["name"], r["level"], r["linked"]) for r in chat.link_tool_calls(calls, results).collect())
    assert found == [
        (1, "search", 0, False), (2, "lookup", 0, False), (3, "search", 0, False), (4, "lookup", 0, False), (5, "lookup", 0, True)
    ]
    turns = spark.createDataFrame(
        [(None, 1, "assistant", "a"), (None, 1, "assistant", "b"), (2, None, "assistant", "c"), (2, None, "assistant", "d")],
        "conv_id long, turn long, role string, text string",
    )
    assert len(chat.link_tool_calls(*chat.calls_of_turns(turns)).collect()) == 4


def test_a_licence_at_the_root_speaks_for_the_whole_tree(spark):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame(
        [(1, "LICENSE", notice), (2, "x.txt", "plain"), (3, "a/b/y.txt", "plain"), (4, "c/LICENSE", "Licensed under CC BY 4.0."),
         (5, "c/d/z.txt", "plain"), (6, None, "plain")],
        "doc_id long, path string, text string",
    )
    found = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in licenses.licenses(docs).collect()}
    assert found == {
        1: ("MIT", "header", None), 2: ("MIT", "inherited", ""), 3: ("MIT", "inherited", ""), 4: ("CC-BY-4.0", "header", None),
        5: ("CC-BY-4.0", "inherited", "c"), 6: (None, "none", None),
    }


def test_every_window_is_compared_with_its_notice(spark):
    """A window whose three rarest terms are not at their places, or missing, is found too."""
    filler = " ".join(f"x{k}" for k in range(40))
    wrong_place = "Mozilla Public License, v. 2.0, is what this Source Code Form is subject to"
    cut = "hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [f"{filler} {wrong_place} {filler}", f"{filler}\n{filler} {cut} {filler}", filler, "Released under"]
    texts += ["permission", "the mozilla", "mpl", "source code form"] * 3 + ["person obtaining charge granted copy hereby free any"] * 40
    docs = spark.createDataFrame([(k, t, f"{k}.txt") for k, t in enumerate(texts)], "doc_id long, text string, path string")
    found = {r["doc_id"]: (r["own_license"], r["line"]) for r in licenses.scan(docs).collect()}
    assert found[0] == ("MPL-2.0", 0) and found[1] == ("MIT", 1) and 2 not in found
