"""Packing of token sequences by minimum bin slack.

Every partition of the documents is packed by itself, in one pass and without a shuffle: a task reads documents,
turns them into ids and keeps a pool of pieces that are not placed yet. Whole windows of a long document are
sequences at once; its rest joins the pool. When the pool is full, and at the end, windows are filled:

1. The lengths in the pool, with how many pieces have each, are a multiset. A bitset holds the sums that
   subsets of it reach; lengths are added from the longest down, their counts in powers of two, until the window's
   capacity is reached or no length is left. The highest reachable sum leaves the least slack, and going back
   over the steps gives how many pieces of each length it takes. The longest piece is tried as a fixed part first;
   only if it leaves a slack, all multisets are.
2. If even that leaves a slack, the longest piece left over is cut so that its beginning fills it.
3. When less than a window is left, the window is the largest power of two that the rest fills.

So every sequence holds exactly ``capacity`` ids, or a power of two of them, and needs no padding; pieces are cut only
where no multiset of whole ones fits. Per partition at most one sequence of each power of two is shorter.

A sequence's id is the partition's number times 2^33, plus its number there. A partition read from files is the same
in every attempt, so a repeated task repeats its sequences; documents that come out of a shuffle should be stored first.
Memory: one Arrow batch, a pool of ``POOL_IDS`` ids and the longest document's ids.

Words are turned into ids by the tokenizer library and remembered, ``KNOWN`` at most, then forgotten.

Defined results: a null or empty text holds the end id only; a special token's string inside a text is that token, the
library's default; repeated rows, and rows without an id, are packed each; pieces of one length are taken in the order
of the rows; other columns are not read; an empty table gives an empty result; very long texts become many pieces.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import text_of

CAPACITY = 2048
END = 1
POOL_IDS = 1 << 21
KNOWN = 1_000_000
#: Bytes of texts that are turned into ids at once; a longer text is alone.
CHUNK_BYTES = 1 << 20
ID_BYTES = 4
#: A stop at a word's end after an ASCII letter or digit: nothing composes with it or joins it.
STOP = re.compile(rb"[.,](?<=[a-z0-9].)(?=[\x20\n])")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` best, the longest lengths first.

    ``lengths`` are ascending and ``counts`` has the number of pieces of each.
    """
    reach, mask = 1, (1 << capacity + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for at in reversed(range(bisect_right(lengths, capacity))):
        length = lengths[at]
        left, copies = min(counts[length], capacity // length), 1
        while left and not reach >> capacity:
            taken = min(copies, left)
            wider = reach | reach << taken * length & mask
            if wider != reach:
                steps.append((length, taken, reach))
                reach = wider
            left -= taken
            copies *= 2
        if reach >> capacity:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, taken, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + taken
            at -= taken * length
    return chosen


def least_slack(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """A best multiset, one with the longest piece if that leaves no slack."""
    fitting = bisect_right(lengths, capacity)
    if not fitting:
        return {}
    longest = lengths[fitting - 1]
    chosen = fullest(lengths, counts | {longest: counts[longest] - 1}, capacity - longest)
    chosen[longest] = chosen.get(longest, 0) + 1
    if sum(length * n for length, n in chosen.items()) == capacity:
        return chosen
    return fullest(lengths, counts, capacity)


class Pool:
    """Pieces that have no place yet: (document, first id, ids) by length."""

    def __init__(self) -> None:
        self.pieces: dict[int, deque[tuple[int, int, bytes]]] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.size = 0

    def add(self, document: int, start: int, ids: bytes, first: bool = False) -> None:
        length = len(ids) // ID_BYTES
        if length:
            own = self.pieces[length]
            own.appendleft((document, start, ids)) if first else own.append((document, start, ids))
            if length not in self.counts:
                insort(self.lengths, length)
            self.counts[length] = self.counts.get(length, 0) + 1
            self.size += length

    def take(self, length: int) -> tuple[int, int, bytes]:
        piece = self.pieces[length].popleft()
        self.size -= length
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length], self.pieces[length], self.lengths[bisect_left(self.lengths, length)]
        return piece

    def window(self, capacity: int) -> list[tuple[int, int, bytes]]:
        """Pieces of exactly ``capacity`` ids; the pool holds as many at least."""
        placed = [self.take(length) for length, n in least_slack(self.lengths, self.counts, capacity).items() for _ in range(n)]
        slack = capacity - sum(len(ids) for _, _, ids in placed) // ID_BYTES
        if slack:
            document, start, ids = self.take(self.lengths[-1])
            placed.append((document, start, ids[: slack * ID_BYTES]))
            self.add(document, start + slack, ids[slack * ID_BYTES :], first=True)
        return placed


class WordIds:
    """Ids of texts as bytes, unsigned 32-bit little-endian.

    The tokenizer drops white space, never joins words and lower-cases, so a text's ids are those of its words one
    after another, capitals as small letters (but for texts that may hold a special token's string). Words of
    letters are encoded many at once and told apart by the ids that end a word; a full stop or comma after letters or
    digits is a word by itself to the tokenizer, so fewer words are to be remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() if b"<|" in t else STOP.sub(rb" \g<0>", t.lower()).split() for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.learn([w for w in set().union(*words) if w not in self.known])
        return [b"".join(map(self.known.__getitem__, own)) for own in words]

    def learn(self, words: list[bytes]) -> None:
        letters, marked, other = set(), [], []
        for w in words:
            if w.isalpha():  # bytes: ASCII letters
                letters.add(w)
                continue
            text = w.decode()
            if of_letters(text):
                letters.add(w)
            elif text[-1] in ".," and of_letters(text[:-1]):
                marked.append(w)
                letters.add(w[:-1])
            else:
                other.append(w)
        self.many([w for w in letters if w not in self.known])
        self.single([w for w in (b".", b",") if w not in self.known] + other)
        known = self.known
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in marked)

    def many(self, words: list[bytes]) -> None:
        """Words of letters only."""
        if not words:
            return
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = ID_BYTES * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):  # a letter that becomes more than letters
            self.single(words)
            return
        flat, bounds = ids.tobytes(), ends.tolist()
        self.known.update((w, flat[a:b]) for w, a, b in zip(words, [0, *bounds], bounds, strict=False))

    def single(self, words: list[bytes]) -> None:
        found = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(words, found, strict=True))


def of_letters(text: str) -> bool:
    """Whether a word holds letters only, also once it is composed and lower-cased."""
    return text.isalpha() and (text.isascii() or normalize("NFC", text).lower().isalpha())


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process, kept between tasks."""
    return WordIds(path)


class Packer:
    """Packs the documents of a partition as they come."""

    def __init__(self, capacity: int, pool_ids: int, sequence: int):
        self.capacity, self.pool_ids, self.sequence = capacity, pool_ids, sequence
        self.pool = Pool()
        self.waiting: dict[int, list] = {}  # document -> its id, its number of ids, ids not placed
        self.document = 0
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple[int, int, bytes]]) -> None:
        offset = 0
        for document, start, ids in pieces:
            own = self.waiting[document]
            length = len(ids) // ID_BYTES
            self.rows.append((own[0], start, length, ids, own[1], self.sequence, offset))
            offset += length
            own[2] -= length
            if not own[2]:
                del self.waiting[document]
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, whole = len(ids) // ID_BYTES, len(ids) // ID_BYTES // self.capacity * self.capacity
        self.waiting[self.document] = [doc_id, n, n]
        for start in range(0, whole, self.capacity):
            self.place([(self.document, start, ids[start * ID_BYTES : (start + self.capacity) * ID_BYTES])])
        self.pool.add(self.document, whole, ids[whole * ID_BYTES :])
        self.document += 1
        if self.pool.size > self.pool_ids:
            self.fill(self.pool_ids // 2)

    def fill(self, rest: int) -> None:
        """Fills windows until ``rest`` ids at most are left."""
        while self.pool.size > rest:
            whole = self.pool.size >= self.capacity
            self.place(self.pool.window(self.capacity if whole else 1 << self.pool.size.bit_length() - 1))

    def batch(self) -> pa.RecordBatch:
        """The rows so far."""
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, pool_ids: int = POOL_IDS,
) -> DataFrame:
    """Rows doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset.

    A document is its text's ids under the tokenizer file ``vocabulary`` (a path on every executor) and the id ``end``.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(capacity, pool_ids, (context.partitionId() if context else 0) << 33)
        encode, last = word_ids(vocabulary), np.array([end], dtype="<u4").tobytes()
        for batch in it:
            texts, names = batch.column(1).cast(pa.large_binary()), batch.column(0).to_pylist()
            start = held = 0
            for k in range(len(texts)):
                held += len(texts[k].as_buffer())
                if held > CHUNK_BYTES or k + 1 == len(texts):
                    for name, ids in zip(names[start : k + 1], encode(texts.slice(start, k + 1 - start).to_pylist()), strict=True):
                        packer.add(name, ids + last)
                    start, held = k + 1, 0
                    yield packer.batch()
        packer.fill(0)
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
