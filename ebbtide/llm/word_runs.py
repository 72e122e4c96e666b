"""Periodic runs of words, found by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q, at least max(``LEAST``, 2 q) long, that no neighbouring word
extends keeping q. A text's words become integers; a batch of texts is one integer array, with a value of its own
after every text so that nothing reaches across.

1. Blocks of 2^k words have 64-bit hashes, built from those of half the length.
2. Periods 1 to 5 are read off directly: stretches of words that equal the word q places on.
3. At scale t (a power of two) periods 3 t to 6 t - 1 are looked for. A position is in the synchronising set if the
   least hash among the blocks of t words that start at most t places on is that of the first or the last of
   them; so membership depends on the next 2 t words only. Blocks inside a region of period t / 3 at most (a run
   found at lower scales) don't take part. If a run holds a position in its first period, the place a period on is in
   the set too and has the same context of 2 t words: pairs of equal contexts 3 t to 6 t - 1 apart propose
   their distance. Positions are sparse, so there are a few pairs per t words.
4. Runs without such a position have a first period that lies in one region of a small period q and a second in the
   next one of the same q. Such neighbouring regions propose the distances that align them.
5. Every proposal is extended both ways by jumps of halving block lengths; what isn't two periods long goes. The same
   stretch found under several periods keeps the least.

Runs are exact but for collisions of 64-bit hashes, which a final comparison of the words turns into misses of no
consequence: a false proposal is dropped.

A text is worked on whole, in one task, with some 8 bytes per word and level (a level per doubling of its length).

Defined results: a null or empty text has no words, no run and an empty collapsed text; repeated rows give a row each;
of equally long runs the first is the longest, then that of the smaller period; other columns are not read; an empty
table gives an empty result; very long texts form a batch of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import text_of, words_of
from ebbtide.llm.jaccard_join import mixed

LEAST = 12
#: Bytes of texts that are worked on at once; a longer text is alone.
CHUNK_BYTES = 1 << 20
DIRECT = 5
SEED = 0xD6E8FEB86659FD93
NONE = np.zeros(0, dtype=np.int64)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of ``counts`` things each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Blocks:
    """Hashes of all blocks of 2^k codes; level k covers the first ``reach[k]`` places only."""

    def __init__(self, codes: np.ndarray, reach: list[int]):
        self.levels = [mixed(codes.astype(np.uint64), SEED)]
        for k, places in enumerate(reach[1:], 1):
            half = self.levels[-1][:places]
            step = 1 << (k - 1)
            self.levels.append(mixed(mixed(half[: max(len(half) - step, 0)], SEED + k) + half[step:]))

    def same(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the blocks of 2^k codes at x and at y are equal; blocks beyond an end never are."""
        level = self.levels[k]
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(level))
        found = np.zeros(len(x), dtype=bool)
        at = np.flatnonzero(inside)
        found[at] = level[x[at]] == level[y[at]]
        return found

    def extend(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many codes before x and y agree, and how many from x and y on."""
        before, after = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            size = 1 << k
            before += size * self.same(k, x - before - size, y - before - size)
            after += size * self.same(k, x + after, y + after)
        return before, after


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def synchronising(blocks: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Synchronising positions among blocks of ``scale`` codes; ``periodic`` blocks take no part."""
    rank = np.where(periodic, np.uint64(2**64 - 1), mixed(blocks, SEED))
    if len(rank) <= scale:
        return NONE
    least = window_least(rank, scale + 1)
    chosen = (least == rank[: len(least)]) | (least == rank[scale:])
    return np.flatnonzero(chosen & (least < np.uint64(2**64 - 1)))


def equal_pairs(at: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, distance) of the ascending positions ``at`` with equal contexts and distance in [low, high)."""
    order = np.argsort(context, kind="stable")
    c, x = context[order], at[order]
    starts, lengths = [], []
    first = np.arange(len(x))
    lag = 1
    while len(first):
        first = first[first + lag < len(x)]
        distance = x[first + lag] - x[first]
        near = (c[first + lag] == c[first]) & (distance < high)
        first, distance = first[near], distance[near]
        wide = distance >= low
        starts.append(x[first[wide]])
        lengths.append(distance[wide])
        lag += 1
    return np.concatenate([NONE, *starts]), np.concatenate([NONE, *lengths])


def aligned_regions(
    blocks: Blocks, start: np.ndarray, end: np.ndarray, period: np.ndarray, low: int, high: int
) -> tuple[np.ndarray, np.ndarray]:
    """(x, distance in [low, high)) that align two neighbouring regions of one small period."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    beside = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]) & (start[1:] > start[:-1]))
    if not len(beside):
        return NONE, NONE
    q, first, second = period[beside], end[beside] - period[beside], start[beside + 1]
    owner, turn = ragged(q)
    level = np.floor(np.log2(q)).astype(np.int64)[owner]
    x, y, rest = first[owner], second[owner] + turn, q[owner] - (1 << level)
    same = np.zeros(len(owner), dtype=bool)
    for k in np.unique(level):
        own = level == k
        same[own] = blocks.same(int(k), x[own], y[own]) & blocks.same(int(k), x[own] + rest[own], y[own] + rest[own])
    pair, least = owner[same], (y - x)[same]
    length = np.minimum(end - start, high - 1)
    most = np.minimum(length[beside], length[beside + 1])[pair]
    least = least + -(-np.maximum(low - least, 0) // q[pair]) * q[pair]
    number = np.maximum((most - least) // q[pair] + 1, 0)
    owner, turn = ragged(number)
    distance = least[owner] + turn * q[pair][owner]
    at = beside[pair][owner]
    return np.maximum(start[at], start[at + 1] - distance), distance


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start; places are in ``codes``.

    ``codes`` holds sequences of the descending ``lengths``, each followed by one code that occurs nowhere else.
    """
    if not len(lengths) or lengths[0] < 2:
        return NONE, NONE, NONE
    ends = np.cumsum(lengths + 1)

    def places(shortest: int) -> int:
        """Places of the sequences that are at least so long."""
        n = int(np.searchsorted(-lengths, -shortest, side="right"))
        return int(ends[n - 1]) if n else 0

    top = int(lengths[0]).bit_length()
    blocks = Blocks(codes, [places(1 << k) for k in range(top)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        size = end - start
        # shorter ones are no result, but regions at higher scales
        good = (size >= 2 * period) & ((size >= least) | (size >= 3 * period))
        found.append((start[good], end[good], period[good]))

    for q in range(1, DIRECT + 1):
        same = np.r_[False, codes[q:] == codes[:-q], False]
        change = np.flatnonzero(same[1:] != same[:-1])
        keep(change[::2], change[1::2] + q, np.full(len(change) // 2, q))
    k = 1
    while places(6 << k):
        scale, used = 1 << k, places(6 << k)
        level = blocks.levels[k][: used - scale + 1]
        start, end, period = map(np.concatenate, zip(*found, strict=True))
        small = (3 * period <= scale) & (start < used)
        start, end, period = start[small], end[small], period[small]
        whole = end - start >= scale
        edge = np.bincount(start[whole], minlength=len(level) + 1) - np.bincount(end[whole] - scale + 1, minlength=len(level) + 1)
        at = synchronising(level, scale, np.cumsum(edge)[: len(level)] > 0)
        at = at[at < len(blocks.levels[k + 1])]
        x, distance = equal_pairs(at, blocks.levels[k + 1][at], 3 * scale, 6 * scale)
        wide = end - start >= 3 * scale
        x2, distance2 = aligned_regions(blocks, start[wide], end[wide], period[wide], 3 * scale, 6 * scale)
        x, distance = np.r_[x, x2], np.r_[distance, distance2]
        before, after = blocks.extend(x, x + distance)
        keep(x - before, x + distance + after, distance)
        k += 1
    start, end, period = map(np.concatenate, zip(*found, strict=True))
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    return verified(codes, start[new], end[new], period[new])


def verified(codes: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs whose words do repeat."""
    good = np.array([np.array_equal(codes[s : e - q], codes[s + q : e]) for s, e, q in zip(start, end, period, strict=True)], dtype=bool)
    return start[good], end[good], period[good]


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most CHUNK_BYTES, of one row at least."""
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > CHUNK_BYTES:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def text_runs(texts: list[bytes], least: int = LEAST) -> tuple[list[np.ndarray], list[bytes]]:
    """Per text its runs as rows (start, length, period), and its words without the repeats, one space between."""
    words = [t.split() for t in texts]  # bytes split at exactly the separators
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.empty(int(lengths.sum()), dtype=object)
    flat[:] = [w for k in order for w in words[k]]
    codes, distinct = pd.factorize(flat)
    own = lengths[order]
    first = np.cumsum(own + 1) - own - 1
    spread = np.full(len(codes) + len(own), -1, dtype=np.int64)
    spread[first + own] = len(distinct) + np.arange(len(own))
    spread[spread < 0] = codes
    start, end, period = find_runs(spread, own, least)
    bounds = np.searchsorted(start, np.r_[first, len(spread)])
    runs: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    collapsed = [b""] * len(texts)
    for place, k in enumerate(order.tolist()):
        a, b = bounds[place], bounds[place + 1]
        if a == b:
            collapsed[k] = b" ".join(words[k])
            continue
        runs[k] = np.stack([start[a:b] - first[place], end[a:b] - start[a:b], period[a:b]], axis=1)
        edge = np.zeros(len(words[k]) + 1, dtype=np.int64)
        np.add.at(edge, runs[k][:, 0] + runs[k][:, 2], 1)
        np.add.at(edge, runs[k][:, 0] + runs[k][:, 1], -1)
        collapsed[k] = b" ".join([words[k][i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
    return runs, collapsed


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period, by start) and collapsed.

    ``collapsed`` is the text without the words of any run after its first period, words joined by one space.
    """
    kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column(1).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1])
            for a, b in _chunks(sizes):
                runs, collapsed = text_runs(column.slice(a, b - a).to_pylist(), least)
                table = np.concatenate(runs)
                held = pa.StructArray.from_arrays([pa.array(table[:, c]) for c in range(3)], fields=list(kind))
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(a, b - a),
                    "runs": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), held),
                    "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
                })

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"),
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("longest.shorter")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        F.col("longest.period").alias("period"), F.expr("(1000 * -longest.shorter) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by crc32 of the id, go on periodically from a word on.

    With h the crc32 and g = h div 10, words from a = g mod n on repeat the next 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("w")).withColumns({
        "n": F.size("w").cast("long"), "g": F.expr("h div 10"),
    }).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), _repeated()).otherwise(F.col("text")).alias("text"))


def _repeated() -> Column:
    head = F.slice("w", F.lit(1), F.col("a").cast("int"))
    period = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    times = F.expr("cast((n - a) div p + 1 as int)")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    return F.array_join(F.concat(head, tail), " ")
