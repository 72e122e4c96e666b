"""Ranked lexical search with deduplicated bags of words.

1. Terms are maximal runs of ASCII letters and digits and of other characters beyond ASCII, A to Z lower-cased. Every
   document becomes its number of terms and its bag: the terms that any item asks for, with their frequencies,
   as bytes in term order. Bags are stored; they give the number of documents and terms and the document frequencies.
2. Documents with equal bags and equal length normalisation m have equal scores for every item. They are
   gathered into classes by a hash of both and verified by comparing both; copies are combined map-side, so a
   class of any size is cheap. A class keeps its least document id.
3. Classes are scored once, in batches: a term's contribution times the items' weights of the term, summed over a
   class's terms, all in 64-bit integers. A task keeps the best ``k`` classes per item by score, then by least id.
   Every class holds a document, so the best ``k`` documents are in the best ``k`` classes.
4. The chosen classes meet their documents again by hash, verified by the bag. The least ``k`` ids of a class can be
   needed only; they are found before classes meet items, so a hot class is not multiplied.

Items are worked on in blocks of at most ``BLOCK_TERMS`` distinct terms (or one item) and ``BLOCK_ITEMS`` items, whose
terms and weights are held by every task: fixed bounds, any number of items. Documents are read once per block of terms.

Scores are as in the item's formula below, with floor division and no rounding but that of the term weights.

Defined results: a null or empty text, or one without a term, is no document to rank and not counted; an item without
terms has no rows; of several items of one id the least text is taken, null being an id too; repeated documents are
ranked each; documents without an id come last among equal scores; other columns are not read; empty tables give
an empty result; very long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import stored, text_of

TOP = 10
BLOCK_TERMS = 1 << 17
BLOCK_ITEMS = 4096
#: Items and classes that are scored at once; the products of a step take about 16 MB.
STEP_ITEMS = 256
STEP_CELLS = 1 << 21
FAR = (1 << 63) - 1
#: Every separator becomes a space, capitals become small letters.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Items:
    """A block of items: ids, terms, and entries (item, term, times) in item order."""

    ids: list
    terms: list[bytes]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def item_blocks(rows: Iterator[tuple], block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> Iterator[Items]:
    """Items (id, text) one after another, in blocks of bounded vocabulary."""
    ids: list = []
    known: dict[bytes, int] = {}
    entries: list[tuple[int, int, int]] = []

    def block() -> Items:
        columns = np.array(entries, dtype=np.int64).reshape(-1, 3)
        return Items(ids, list(known), columns[:, 0], columns[:, 1], columns[:, 2])

    for id_, text in rows:
        own = Counter(terms_of((text or "").encode()))
        if not own:
            continue
        if ids and (len(ids) == block_items or len(known) + sum(t not in known for t in own) > block_terms):
            yield block()
            ids, known, entries = [], {}, []
        for term, times in own.items():
            entries.append((len(ids), known.setdefault(term, len(known)), times))
        ids.append(id_)
    if ids:
        yield block()


def bags(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms) and bag (term numbers and frequencies, 32-bit pairs) of every document with a term."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(terms)}
        for batch in it:
            sizes, bags_ = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                own = terms_of(text.as_py())
                sizes.append(len(own))
                held = np.array([k for k in map(number.get, own) if k is not None], dtype=np.int32)
                found, count = np.unique(held, return_counts=True)
                bags_.append(np.stack([found, count.astype(np.int32)], axis=1).tobytes())
            yield pa.record_batch({
                "doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()), "bag": pa.array(bags_, pa.binary()),
            })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, bag binary").filter("n > 0")


def document_frequencies(held: DataFrame, n_terms: int) -> np.ndarray:
    """How many bags hold each term: one count array per task, summed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, dtype=np.int64)
        for batch in it:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32)
            counts += np.bincount(pairs[::2], minlength=n_terms)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"term": pa.array(used, pa.int64()), "df": pa.array(counts[used], pa.int64())})

    found = held.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    frequencies = np.zeros(n_terms, dtype=np.int64)
    frequencies[found["term"].to_numpy()] = found["df"].to_numpy()
    return frequencies


class Best:
    """The best ``k`` classes of every item so far: score, least id and the class's hash, m and bag."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(n_items)]
        self.least = np.zeros(n_items, dtype=np.int64)  # only scores above 0 count

    def offer(self, first_item: int, scores: np.ndarray, classes: list[tuple]) -> None:
        """``scores`` has a row per class and a column per item from ``first_item`` on."""
        floor = self.least[first_item : first_item + scores.shape[1]]
        better = (scores >= floor) & (scores > 0)
        for column in np.flatnonzero(better.any(axis=0)).tolist():
            own = self.held[first_item + column]
            own += [(-int(scores[row, column]), *classes[row]) for row in np.flatnonzero(better[:, column]).tolist()]
            own.sort()
            del own[self.k :]
            if len(own) == self.k:
                self.least[first_item + column] = -own[-1][0]


def scored_classes(classes: DataFrame, items: Items, weights: np.ndarray, k: int) -> DataFrame:
    """Per task the best classes of every item: item (its number), score, least, h, m and bag."""
    schema = "item int, score long, least long, h long, m long, bag binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        blocks = []
        for first in range(0, len(items.ids), STEP_ITEMS):
            own = slice(*np.searchsorted(items.item, [first, first + STEP_ITEMS]))
            used, place = np.unique(items.term[own], return_inverse=True)
            dense = np.zeros((len(used), min(STEP_ITEMS, len(items.ids) - first)), dtype=np.int64)
            dense[place, items.item[own] - first] = items.times[own] * weights[items.term[own]]
            row_of = np.full(len(items.terms), -1, dtype=np.int64)
            row_of[used] = np.arange(len(used))
            blocks.append((first, row_of, dense))
        for batch in it:
            least, h, m = (batch.column(c).to_numpy() for c in range(3))
            bag = batch.column(3).to_pylist()
            sizes = np.array([len(b) // 8 for b in bag], dtype=np.int64)
            rows_at_once = max(1, STEP_CELLS // STEP_ITEMS // max(int(sizes.max(initial=1)), 1))
            for a in range(0, len(bag), rows_at_once):
                z = min(a + rows_at_once, len(bag))
                pairs = np.frombuffer(b"".join(bag[a:z]), dtype=np.int32).reshape(-1, 2).astype(np.int64)
                row = np.repeat(np.arange(z - a), sizes[a:z])
                part = 1_000_000_000 * pairs[:, 1] // (1000 * pairs[:, 1] + 8 * m[a:z][row])
                named = list(zip(least[a:z].tolist(), h[a:z].tolist(), m[a:z].tolist(), bag[a:z], strict=True))
                for first, row_of, dense in blocks:
                    at = row_of[pairs[:, 0]]
                    asked = np.flatnonzero(at >= 0)
                    if not len(asked):
                        continue
                    starts = np.flatnonzero(np.diff(row[asked], prepend=-1))
                    scores = np.zeros((z - a, dense.shape[1]), dtype=np.int64)
                    scores[row[asked][starts]] = np.add.reduceat(part[asked, None] * dense[at[asked]], starts, axis=0)
                    best.offer(first, scores, named)
        found = [(k_, *row) for k_, own in enumerate(best.held) for row in own]
        columns = list(zip(*found, strict=True)) or [()] * 6
        yield pa.record_batch({
            "item": pa.array(columns[0], pa.int32()), "score": pa.array([-s for s in columns[1]], pa.int64()),
            "least": pa.array(columns[2], pa.int64()), "h": pa.array(columns[3], pa.int64()),
            "m": pa.array(columns[4], pa.int64()), "bag": pa.array(columns[5], pa.binary()),
        })

    return classes.select("least", "h", "m", "bag").mapInArrow(run, schema)


def ranked_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """item (its number), rank, doc_id and score for a block of items."""
    spark = docs.sparkSession
    all_bags = stored(bags(docs, items.terms), "bags")
    n_docs, n_terms = all_bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = document_frequencies(all_bags, len(items.terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)
    asked = all_bags.filter("bag <> X''").select(
        "doc_id", F.expr(f"25 + (75 * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m"), "bag",
    ).withColumn("h", F.xxhash64("bag", "m"))
    # grouping by hash, m and bag compares all three: documents whose hash alone agrees stay apart
    classes = asked.groupBy("h", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(FAR)).alias("least"))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "least", "h", "m", "bag")
    top = scored_classes(classes, items, weights, k).withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k)
    top = stored(top.drop("place", "least"), "top-classes")
    by_id = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    chosen = F.broadcast(top.select("h").distinct())  # k classes per item of a block at most
    members = asked.join(chosen, "h", "left_semi").withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k)
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    found = members.join(top, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` documents with the highest scores above 0 for each item.

    With N documents and L terms in all, n terms in a document and df documents of a term, w is
    floor(1000 ln((2 N + 2) / (2 df + 1))), m is 25 + 75 n N div L, and a score sums w (10^9 tf div (1000 tf + 8 m)) over
    the item's terms, repeats included.
    """
    one = stored(items.groupBy("item_id").agg(F.min("text").alias("text")).filter("text is not null"), "items")
    rows = ((r["item_id"], r["text"]) for r in one.orderBy(F.asc_nulls_last("item_id")).toLocalIterator())
    found = None
    for block in item_blocks(rows, block_terms, block_items):
        part = stored(ranked_block(docs, block, k), "ranked")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
