"""Exact n-gram Jaccard self-join: prefix filters under several global token orders, intersected.

1. Each text becomes the set of its distinct word shingles (64-bit hashes). Equal sets are one node from here.
2. Order one sorts shingles by how many sets hold a shingle of the same slot (``SLOTS`` counters over all
   documents, a broadcast of fixed size), rare ones first. Two sets that meet the threshold share a shingle of
   their prefixes, so sets are gathered under (prefix shingle, size band): at home in the band of their own
   size, and with the shorter prefix that suffices there as guests in the band above.
3. All sets under one key belong to the group of the key's least home set. A group is dealt out in pairs of
   blocks of bounded size, so no group has to fit a task.
4. The filter of order two (by seeded hash) runs on longer prefixes, of which two sets must share more than one
   shingle. Only these prefixes are shuffled; sets without a partner in their group drop out.
5. Whole sets of what is left meet in the same units. Candidates must share prefix shingles under order one *and*
   two *and* three; the filters are intersected and every pair that remains is verified, in the unit of the least
   group that both are in: no pair is lost and none is verified twice. Their number is that of the similar pairs,
   which grows with the square of a group of near copies; ``counted_documents`` adds them up inside their unit and
   hands on a number per set and the links that connect. Where only components are asked for, sets that verified links
   already connect are not compared again.
6. Components of the links that join what was apart inside a unit, by least document id.

Bitmaps of ``BITS`` bits over the ids that are still needed, of fixed size too, keep the others out of the
shuffles of steps 4 and 5. Words and shingles are hashed from the bytes of an Arrow batch by numpy, a bounded
number of bytes at a time.

Defined results: a null or empty text has an empty set, is linked with nothing and is its own component; a
text of fewer words than a shingle is one shingle; repeated texts share a component; other columns are not
read; an empty table gives an empty result. Ids are expected to be unique; a null id takes part in no link.
Results are exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import bounded_batches, count_below, stored, text_of
from ebbtide.llm.components import components

SLOTS = 1 << 18
BITS = 1 << 24
#: Sets and shingles that a block holds on average, at most.
BLOCK_SETS = 256
BLOCK_TOKENS = 1 << 19
CHUNK_BYTES = 1 << 18
#: Rows that a task turns into arrays at once.
BATCH_DOCS = 256
BATCH_SETS = 128
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and a random value of each byte, capitals as small letters."""
    separates = np.zeros(256, dtype=bool)
    separates[[0x20, *range(0x09, 0x0E)]] = True
    folded = np.arange(256, dtype=np.uint64)
    folded[0x41:0x5B] += np.uint64(32)
    return separates, mixed(folded + np.uint64(1), SEEDS[0])


def place_weights(n: int) -> np.ndarray:
    """Odd random factors of the places in a word."""
    return mixed(np.arange(n, dtype=np.uint64), SEEDS[1]) | np.uint64(1)


def _chunk_sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    separates, letter = _tables()
    n_docs = len(bounds) - 1
    at = np.flatnonzero(~separates[raw])
    if not len(at):
        return [np.zeros(0, dtype=np.uint64)] * n_docs
    new = np.r_[True, at[1:] != at[:-1] + 1]
    first_byte = np.searchsorted(at, bounds[:-1])
    new[first_byte[first_byte < len(at)]] = True
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(at)])
    place = np.arange(len(at), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
    value = letter[raw[at]] * place_weights(int(length.max()))[place]
    word = mixed(np.add.reduceat(value, start) + length.astype(np.uint64))
    del place, value
    first = np.searchsorted(start, first_byte)
    after = np.r_[first[1:], len(start)]
    grams = word[: max(len(word) - width + 1, 0)].copy()
    for k in range(1, width):
        grams = mixed(grams) + word[k : k + len(grams)]
    grams = mixed(grams)
    sets = []
    for a, b in zip(first.tolist(), after.tolist(), strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:  # fewer words than a shingle: the whole sequence
            whole = np.array([b - a], dtype=np.uint64)
            for w in word[a:b]:
                whole = mixed(whole, SEEDS[0]) + w
            sets.append(mixed(whole))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text, lower-cased in A to Z; an array without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return []
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    sets: list[np.ndarray] = []
    while len(sets) < len(texts):
        k = len(sets)
        end = max(int(np.searchsorted(offsets, offsets[k] + CHUNK_BYTES, side="right")) - 1, k + 1)
        sets += _chunk_sets(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], width)
    return sets


def slot_of(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(46)).astype(np.int64)


class Threshold:
    """Jaccard similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def home(self, n):
        """Prefix of a set of n for partners of any size."""
        return n - -(-n * self.num // self.den) + 1

    def guest(self, n):
        """Prefix of a set of n for partners that are not smaller."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def shared(self, n):
        """Shingles that linked sets share in their longer prefixes: at least the lesser value of the two."""
        return n // 16 + 1

    def longer(self, n):
        """Length of the prefix that shows ``shared`` common shingles."""
        return self.home(n) + self.shared(n) - 1

    def linked(self, common, n, m):
        return (self.num + self.den) * common >= self.num * (n + m)

    def near(self, size: np.ndarray) -> np.ndarray:
        """Matrix of the sizes that can link."""
        return self.den * np.minimum.outer(size, size) >= self.num * np.maximum.outer(size, size)

    def bands(self) -> list[int]:
        """First sizes of the bands; sizes that can link are in one band or in neighbouring ones."""
        first = [1]
        while first[-1] < 1 << 40:
            first.append(first[-1] * self.den // self.num + 1)
        return first


def _slices(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what a task holds at once."""
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _measured(width: int):
    """Per document its set's size and key, and per task how many sets hold a shingle of each slot."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in _slices(it, BATCH_DOCS):
            sizes, keys, slots = [], [], [np.zeros(0, dtype=np.int64)]
            for own in shingle_sets(batch.column(1), width):
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                slots.append(slot_of(own))
            counts += np.bincount(np.concatenate(slots), minlength=SLOTS)
            n = len(sizes)
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.string()),
                "slot": pa.nulls(n, pa.int32()), "held": pa.nulls(n, pa.int64()),
            })
        used = np.flatnonzero(counts)
        n = len(used)
        yield pa.record_batch({
            "doc_id": pa.nulls(n, pa.int64()), "n_shingles": pa.nulls(n, pa.int64()), "set_key": pa.nulls(n, pa.string()),
            "slot": pa.array(used, pa.int32()), "held": pa.array(counts[used], pa.int64()),
        })

    return run


def rare_first(own: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    """The first n of a set under order one; ties by hash."""
    if n >= len(own):
        return own
    count = np.minimum(held[slot_of(own)], (1 << 20) - 1).astype(np.uint64)
    rank = count << np.uint64(44) | own >> np.uint64(20)
    return own[np.argpartition(rank, n)[:n]]


def seeded_first(own: np.ndarray, seed: int, n: int) -> np.ndarray:
    """The first n of a set under the order of a seeded hash, as those hashes."""
    other = mixed(own, seed)
    return np.partition(other, n)[:n] if n < len(own) else other


def _prefixes(width: int, threshold: Threshold, held: np.ndarray):
    """Per document the keys it is gathered under."""
    bands = threshold.bands()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it, BATCH_DOCS):
            keys = []
            for own in shingle_sets(batch.column(1), width):
                n, band = len(own), bisect_right(bands, len(own))
                home = rare_first(own, held, threshold.home(n)) if n else own
                guest = rare_first(home, held, threshold.guest(n)) if n else own
                # the least bit says who is at home
                home, guest = mixed(home, band) | np.uint64(1), mixed(guest, band + 1) & ~np.uint64(1)
                keys.append(np.r_[home, guest].astype(np.int64))
            yield pa.record_batch({
                "doc_id": batch.column(0),
                "keys": pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64())
                ),
            })

    return run


def _sets(width: int, wanted: np.ndarray, threshold: Threshold | None = None):
    """Size and whole set, or longer prefix under order two, of the documents whose bit is set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(it, BATCH_DOCS):
            bit = batch.column(2).to_numpy()
            at = np.flatnonzero(wanted[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
            part = batch.take(pa.array(at))
            sets = shingle_sets(part.column(1), width)
            sizes = [len(own) for own in sets]
            if threshold is not None:
                sets = [seeded_first(own, SEEDS[0], threshold.longer(len(own))) if len(own) else own for own in sets]
            yield pa.record_batch({
                "doc_id": part.column(0), "size": pa.array(sizes, pa.int64()),
                "tokens": pa.array([own.tobytes() for own in sets], pa.binary()),
            })

    return run


def _runs(tokens: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each token that several sets hold, who holds it."""
    token = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
    for k in np.flatnonzero(np.diff(starts) > 1):
        yield owner[starts[k] : starts[k + 1]]


def _shared(prefixes: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of tokens that prefixes share."""
    n = len(prefixes)
    counts = np.zeros((n, n), dtype=np.int32)
    for own in _runs(prefixes):
        counts[np.ix_(own, own)] += 1
    return counts


def partnered(prefixes: list[np.ndarray], size: np.ndarray, threshold: Threshold, allowed: np.ndarray) -> np.ndarray:
    """Which sets of a unit pass the filters of size and order two with any other."""
    need = threshold.shared(size)
    candidate = allowed & (_shared(prefixes) >= np.minimum.outer(need, need)) & threshold.near(size)
    np.fill_diagonal(candidate, False)
    return candidate.any(axis=1)


def _meets(prefixes: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sets whose prefixes share a token."""
    n = len(prefixes)
    matrix = np.zeros((n, n), dtype=bool)
    for own in _runs(prefixes):
        matrix[np.ix_(own, own)] = True
    return matrix


def unit_pairs(
    sets: list[np.ndarray], threshold: Threshold, held: np.ndarray, allowed: np.ndarray | None = None, every: bool = True
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets of a unit with the later ones that link with them, and which of these links connect what was apart.

    Pairs outside ``allowed`` are other units' work. Without ``every``, only links that connect are looked for.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    prefix = threshold.home(size).tolist()
    candidate = threshold.near(size) & np.triu(np.ones((n, n), dtype=bool), 1)
    if allowed is not None:
        candidate &= allowed
    candidate &= _meets([rare_first(s, held, k) for s, k in zip(sets, prefix, strict=True)])
    for seed in SEEDS:
        if not candidate.any():
            return
        candidate &= _meets([seeded_first(s, seed, k) for s, k in zip(sets, prefix, strict=True)])
    root = np.arange(n)
    token = np.concatenate(sets)
    local = np.unique(token, return_inverse=True)[1] if n > 8 else None
    ends = np.cumsum(size)
    flag = np.zeros(local.max() + 1, dtype=np.int8) if local is not None else None
    for x in range(n):
        others = np.flatnonzero(candidate[x] if every else candidate[x] & (root != root[x]))
        if not len(others):
            continue
        if local is None:
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in others])
        else:
            own = local[ends[x] - size[x] : ends[x]]
            flag[own] = 1
            if 4 * size[others].sum() > len(token):  # most of the unit: all sets at once
                common = np.add.reduceat(flag[local], ends - size, dtype=np.int64)[others]
            else:
                common = np.array([int(flag[local[ends[y] - size[y] : ends[y]]].sum(dtype=np.int64)) for y in others])
            flag[own] = 0
        linked = others[threshold.linked(common, size[x], size[others])]
        connects = root[linked] != root[x]
        for k in np.flatnonzero(connects):
            connects[k] = root[linked[k]] != root[x]
            if connects[k]:
                root[root == root[linked[k]]] = root[x]
        if not every:
            linked, connects = linked[connects], connects[connects]
        yield x, linked, connects


def unit_links(sets: list[np.ndarray], threshold: Threshold, held: np.ndarray, allowed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a unit; pairs outside ``allowed`` are other units' work."""
    return [(x, int(y)) for x, linked, _ in unit_pairs(sets, threshold, held, allowed, every=False) for y in linked]


def _units(threshold: Threshold, held: np.ndarray | None = None, every: bool = True, counted: bool = False):
    """Works on the units (grp, i, j) that a sorted partition holds one after another.

    Gives links, or with no ``held`` the sets that have a partner under order two as (u = group, v = set). If
    ``counted``, only links that connect, and per set (u) how many documents its links in this unit lead to (n).
    """
    bands = threshold.bands()

    def found_in(rows: list[tuple]) -> pa.RecordBatch:
        sets = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        size, block = np.array([r[7] for r in rows]), np.array([r[1] for r in rows])
        grp, i, j, band = rows[0][3:7]
        at_home = np.array([bisect_right(bands, n) == band for n in size.tolist()])
        allowed = np.logical_or.outer(at_home, at_home)
        if i != j:
            allowed &= np.not_equal.outer(block, block)
        if held is None:
            kept = ids[partnered(sets, size, threshold, allowed)]
            return _links(np.full(len(kept), grp), kept, np.ones(len(kept), dtype=bool))
        if every:  # pairs of a lesser group's sets are verified there
            allowed &= ~_meets([np.array(r[8], dtype=np.int64) for r in rows]) & np.not_equal.outer(ids, ids)
        found = [(np.full(len(y), x), y, c) for x, y, c in unit_pairs(sets, threshold, held, allowed, every)]
        if not found:
            return _links()
        x, y, connects = map(np.concatenate, zip(*found, strict=True))
        if counted:
            copies = np.array([r[9] for r in rows], dtype=np.int64)
            reached = np.zeros(len(ids), dtype=np.int64)
            np.add.at(reached, x, copies[y])
            np.add.at(reached, y, copies[x])
            of = np.flatnonzero(reached)
            x, y, connects = x[connects], y[connects], connects[connects]
            return _links(np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), connects, ids[of], reached[of])
        return _links(np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), connects)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in _slices(it, BATCH_SETS):
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if row[3:6] != unit:
                    if len(rows) > 1:
                        yield found_in(rows)
                    unit, rows = row[3:6], []
                rows.append(row)
        if len(rows) > 1:
            yield found_in(rows)

    return run


def _links(u=(), v=(), connects=(), of=(), reached=()) -> pa.RecordBatch:
    """Links, then sets (``of``) with the documents they reach."""
    def padded(values, kind, before, after):
        return pa.array([*[None] * before, *values, *[None] * after], kind)

    return pa.record_batch({
        "u": pa.array([*u, *of], pa.int64()), "v": padded(v, pa.int64(), 0, len(of)),
        "connects": padded(map(bool, connects), pa.bool_(), 0, len(of)), "n": padded(reached, pa.int64(), len(u), 0),
    })


def _bitmap(ids: DataFrame) -> np.ndarray:
    """BITS bits, set where a hashed id falls: 2 MB on the driver and in tasks, however many ids there are."""
    words = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("bit")).groupBy(
        F.shiftright("bit", 6).cast("int").alias("word")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = words.toArrow()
    bitmap = np.zeros(BITS // 64, dtype=np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bitmap


def similar_documents(
    docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, every: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles, component_id, node of each document, and all links between nodes.

    Documents link when their sets' Jaccard similarity is at least ``num / den``. A node is the least document of
    those with equal sets (null for empty sets). ``links`` (u, v), u < v, holds every pair of nodes that link;
    without ``every`` only as many as the components need.
    """
    members, _, links, _ = _joined(docs, width, num, den, every, False)
    return members, links


def _joined(
    docs: DataFrame, width: int, num: int, den: int, every: bool, counted: bool
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links, documents reached by each node's links if ``counted``)."""
    threshold = Threshold(num, den)
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    measured = stored(texts.mapInArrow(
        _measured(width), "doc_id long, n_shingles long, set_key string, slot int, held long"
    ), "sets")
    per_slot = measured.filter("slot is not null").groupBy("slot").agg(F.sum("held").alias("held")).toArrow()
    held = np.zeros(SLOTS, dtype=np.int64)
    held[per_slot["slot"].to_numpy()] = per_slot["held"].to_numpy()

    members = measured.filter("slot is null").select("doc_id", "n_shingles", "set_key")
    nodes = members.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("copies")
    )
    nodes = stored(nodes.filter("doc_id is not null"), "nodes")
    keyed = texts.mapInArrow(_prefixes(width, threshold, held), "doc_id long, keys array<bigint>").join(
        nodes.select("doc_id"), "doc_id", "left_semi"
    )
    keys = keyed.select("doc_id", F.explode("keys").alias("k")).select(
        "doc_id", F.expr("k | 1L").alias("k"), F.expr("k & 1L").cast("boolean").alias("home")
    )
    shared = keys.groupBy("k").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("home"), F.col("doc_id"))).alias("grp")
    ).filter("n > 1 and grp is not null").select("k", "grp")
    grouped = stored(keys.select("k", "doc_id").join(shared, "k").select("grp", "doc_id").distinct(), "groups")

    hashed = texts.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("bit"))

    def in_units(groups: DataFrame, prefix_of: Threshold | None, work) -> DataFrame:
        sized = groups.join(members.select("doc_id", "n_shingles"), "doc_id")
        blocks = sized.groupBy("grp").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_TOKENS)).cast("int").alias("blocks"),
            F.count("*").alias("n"),
        ).filter("n > 1").join(members.select(F.col("doc_id").alias("grp"), F.col("n_shingles").alias("home_size")).distinct(), "grp")
        dealt = groups.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).select(
            "grp", "doc_id", "block", "blocks", count_below(threshold.bands(), F.col("home_size"), including=True).alias("band"),
        )
        if prefix_of is None and every:
            same_band = F.collect_set("grp").over(Window.partitionBy("doc_id", "band"))
            dealt = dealt.withColumn("lesser", F.filter(same_band, lambda g: g < F.col("grp")))
        else:
            dealt = dealt.withColumn("lesser", F.lit(None).cast("array<bigint>"))
        copies = F.lit(None).cast("long")
        if prefix_of is None and counted:
            dealt, copies = dealt.join(nodes.select("doc_id", "copies"), "doc_id"), F.col("copies")
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        sets = hashed.mapInArrow(_sets(width, _bitmap(groups), prefix_of), "doc_id long, size long, tokens binary")
        units = dealt.join(sets, "doc_id").select(
            "doc_id", "block", "tokens", "grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "size",
            "lesser", copies.alias("copies"),
        )
        found = units.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(work, "u long, v long, connects boolean, n long")
        return found.groupBy("u", "v").agg(F.max("connects").alias("connects"), F.sum("n").alias("n"))

    paired = in_units(grouped, threshold, _units(threshold)).select(F.col("u").alias("grp"), F.col("v").alias("doc_id"))
    paired = stored(paired, "partnered")
    found = stored(in_units(paired, None, _units(threshold, held, every, counted)), "links")
    links = found.filter("v is not null")
    named = components(links.filter("connects").select("u", "v"))
    labelled = nodes.withColumnRenamed("doc_id", "of_set").join(named, F.col("of_set") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "of_set").alias("component_id"), F.col("of_set").alias("node")
    )
    result = members.join(labelled, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node"
    )
    reached = found.filter("v is null").select(F.col("u").alias("of"), F.col("n").alias("linked"))
    return result, nodes.select(F.col("doc_id").alias("node"), F.col("copies").alias("n")), links.select("u", "v"), reached


def counted_documents(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other documents it links with) of each document.

    All pairs are verified and counted; only those that connect are handed on.
    """
    members, sizes, _, reached = _joined(docs, width, num, den, True, True)
    return _with_counts(members, sizes, reached).select("doc_id", "n_shingles", "component_id", "n_links")


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id and n_links: the other documents that a document links with, those of an equal set among them."""
    sizes = members.filter("node is not null and doc_id is not null").groupBy("node").agg(F.count_distinct("doc_id").alias("n"))
    both = links.select(F.col("u").alias("of"), F.col("v").alias("node")).union(
        links.select(F.col("v").alias("of"), F.col("u").alias("node"))
    )
    others = both.join(sizes, "node").groupBy("of").agg(F.sum("n").alias("linked"))
    return _with_counts(members, sizes, others).select("doc_id", "n_links")


def _with_counts(members: DataFrame, sizes: DataFrame, others: DataFrame) -> DataFrame:
    """Members with n_links, from the documents of each node (n) and those its links lead to (linked)."""
    counts = sizes.join(others, F.col("node") == F.col("of"), "left").select(
        "node", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    return members.join(counts, "node", "left").withColumn(
        "n_links", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    )
