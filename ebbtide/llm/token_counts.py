"""Token counts by rank-synchronous merging of ragged symbol arrays.

Texts are cut into pre-tokens as the vocabulary's byte-level pre-tokenizer does. The distinct pre-tokens of a
batch form one ragged numpy array of byte symbols. In every round each sequence applies its lowest-ranked
pair, all occurrences at once from the left, until no sequence holds a mergeable pair; what counts is the
number of surviving symbols. A merge can only create pairs of a later rank, so a round per rank gives the
same symbols as one merge at a time.

Memory is bounded by the Arrow batch and by ``CACHE_ENTRIES`` remembered pre-tokens a worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special token's string inside a text counts
as one token, the library's default; repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 600_000
CHUNK_CHARS = 1_000_000
#: The pre-tokenizer's pattern, with white space as the Unicode property.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in printable}
    others = (b for b in range(256) if b not in symbols)
    symbols |= {b: chr(256 + k) for k, b in enumerate(others)}
    return [symbols[b] for b in range(256)]


class MergeTable:
    """Ranks and results of all merges, searched as one sorted array of packed pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.last = len(keys)
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), self.last - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.last)

    def count(self, pieces: list[str]) -> np.ndarray:
        """Surviving symbols of each piece."""
        raw = [p.encode() for p in pieces]
        counts = np.array([len(b) for b in raw], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), counts)
        rank = self.ranks_at(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            best = np.minimum.reduceat(rank, starts)
            over = best >= self.last
            counts[owner[starts[over]]] = lengths[over]
            at = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank < self.last))
            if not len(at):
                break
            # of overlapping equal pairs, every second one from the left of the run
            order = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], order, 0))
            at = at[(order - first) % 2 == 0]
            symbols[at] = self.results[rank[at]]
            keep = np.repeat(~over, lengths)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = np.r_[place[at], np.maximum(place[at] - 1, 0)]
            rank[changed] = self.ranks_at(symbols, owner, changed)
        return counts

    def ranks_at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each position; ``last`` where its sequence ends."""
        after = np.minimum(at + 1, len(symbols) - 1)
        found = self.rank_of(symbols[at], symbols[after])
        found[(after == at) | (owner[after] != owner[at])] = self.last
        return found


def irregular(text: str) -> bool:
    """Whether spaces and line feeds stand beside each other or at an end."""
    return any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[:1].isspace() or text[-1:].isspace()


class Counter:
    """Counts tokens of texts, remembering the counts of frequent words.

    The pre-tokenizer always cuts before a single space and around a single line feed that have no other
    white space beside them, so such texts are counted word by word, each with the space before it.
    """

    def __init__(self, path: str):
        self.merges = MergeTable(path)
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        """Tokens of each text, ``CHUNK_CHARS`` characters of texts at a time."""
        counts: list[int] = []
        start = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_CHARS or k + 1 == len(texts):
                counts += self.chunk(texts[start : k + 1])
                start, size = k + 1, 0
        return counts

    def chunk(self, texts: list[str]) -> list[int]:
        """A text's keys are its words after a space, then "\n" and the first words of its lines."""
        special = self.merges.special
        cut = [special.split(t) if special and special.search(t) else [t] for t in texts]
        keys = [self.keys_of(parts) for parts in cut]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        self.learn([k for k in set().union(*keys) if k not in self.known])
        get = self.known.__getitem__
        counts = []
        for parts, own in zip(cut, keys, strict=True):
            try:
                breaks = sum(p.count("\n") for p in parts if not irregular(p))
                counts.append(len(parts) - 1 + breaks + sum(map(get, own)))
            except TypeError:  # a word with other white space at an end
                pieces = [p for part in parts for p in self.merges.pieces.findall(part)]
                counts.append(len(parts) - 1 + int(self.merges.count(pieces).sum()))
        return counts

    @staticmethod
    def keys_of(parts: list[str]) -> list[str]:
        own: list[str] = []
        for part in parts:
            if irregular(part):
                own.append("\n" + part)
                continue
            for line in part.split("\n"):
                first, *rest = line.split(" ")
                own.append("\n" + first)
                own += rest
        return own

    def learn(self, keys: list[str]) -> None:
        cut = [self.pieces_of(k) for k in keys]
        distinct = list(set().union(*filter(None, cut)))
        counts = dict(zip(distinct, self.merges.count(distinct).tolist(), strict=True))
        get = counts.__getitem__
        self.known.update((k, None if p is None else sum(map(get, p))) for k, p in zip(keys, cut, strict=True))

    def pieces_of(self, key: str) -> list[str] | None:
        """Pre-tokens of a key; None if they may reach into its neighbours."""
        if key.isalpha():
            return [" " + key]
        if key[-1:] in (".", ",") and key[:-1].isalpha():
            return [" " + key[:-1], key[-1]]
        if key[:1] == "\n":
            text = key[1:]
            if not irregular(text) or " " in text or "\n" in text:
                return self.merges.pieces.findall(text)
            return None
        return None if irregular(key) else self.merges.pieces.findall(" " + key)


@lru_cache(maxsize=4)
def counter_of(path: str) -> Counter:
    """One counter per worker process, kept between tasks."""
    return Counter(path)


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of ``text`` under the byte-level vocabulary file at ``vocabulary`` (a path on every executor)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(vocabulary)
        for batch in batches:
            yield pd.Series(counter(batch.tolist()), dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, vocabulary).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
