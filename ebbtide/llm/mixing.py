"""Mixing sources to target weights: blocks of words, multinomial draws per shard, permuted indices.

1. The words of a source, its documents in hashed order, are packed into blocks of ``block`` words; the last may
   be shorter. A document's place is its running total, by hash bucket first and inside a bucket then, so no
   source is ordered in one task.
2. A source's target becomes a quota of blocks. Every slot of every output shard draws a source with
   probability quota / slots, which makes the source counts of a shard multinomial. Draws beyond a source's
   quota go, in order, to sources that drew less, so the totals are the quotas.
3. The q-th slot of a source takes block ``perm(q mod n)`` in epoch ``q div n`` of its n blocks, ``perm`` being a
   swap-or-not permutation keyed by seed, source and epoch: every block is taken once an epoch.
4. Slots and documents' pieces meet by (source, block index). At most two slots and a few pieces have one key.

The table of sources (one row each) is held by the driver, as targets need all of them: a mixture has few.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source, the last one;
with no words at all every target is 0; repeated rows are taken each; other columns are not read; an empty table
gives an empty result. All draws are seeded by position, so reruns and retried tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import count_below, count_words, long_array, stored, words_of

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MOST = 2
BLOCK = 128
SHARD_SLOTS = 4096
BUCKET_DOCS = 4096
ROUNDS = 24
SEED = 20_240_601


def targets(sizes: list[int], weights: list[int], share: tuple[int, int] = SHARE, most: int = MOST) -> list[float]:
    """share[0] / share[1] of all sizes by weight, none above ``most`` times its size, the excess reshared."""
    total = sum(sizes) * share[0] / share[1]
    open_, capped = set(range(len(sizes))), set()
    while open_:
        left = total - sum(most * sizes[k] for k in capped)
        weight = sum(weights[k] for k in open_)
        above = {k for k in open_ if left * weights[k] / weight > most * sizes[k]}
        if not above:
            break
        open_ -= above
        capped |= above
    return [float(most * sizes[k]) if k in capped else left * weights[k] / weight for k in range(len(sizes))]


@dataclass
class Plan:
    """Per source, in order: name, words, target, blocks and quota of blocks."""

    names: list
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    quotas: list[int]


def placed_documents(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, ``keys`` and start: the running total of words before it in its source."""
    sized = stored(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), *keys), "mix-sizes"
    )
    buckets = max(1, sized.count() // BUCKET_DOCS)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, 0)
    running = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size")).alias("d")
    match = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))
    return running.join(before.alias("b"), match).select(
        "doc_id", "d.source", "size", *keys, (F.col("inside") + F.col("before")).cast("long").alias("start")
    )


def plan_sources(placed: DataFrame, block: int) -> Plan:
    rows = placed.groupBy("source").agg(F.sum("size").alias("words")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # str compares by code point
    sizes = [r["words"] for r in rows]
    wanted = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))])
    blocks = [-(-n // block) for n in sizes]
    quotas = [min(MOST * b, round(t * b / n)) if n else 0 for t, b, n in zip(wanted, blocks, sizes, strict=True)]
    return Plan([r["source"] for r in rows], sizes, wanted, blocks, quotas)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not permutation of 0 .. n - 1."""

    def swap(i: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), n) - i, n)
        bit = F.xxhash64(F.greatest(i, partner), r, *key).bitwiseAND(1)
        return F.when(bit == 1, partner).otherwise(i)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def draw_slots(spark, plan: Plan, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, slot, s (index of the source) and block of every slot of the mix."""
    quotas, total = plan.quotas, sum(plan.quotas)
    ends = list(accumulate(quotas))
    slots = spark.range(total).select(
        F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), F.col("id").alias("slot"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("ticket"),
    ).select("shard", "slot", count_below(ends, F.col("ticket"), including=True).alias("s"))
    counts = stored(slots.groupBy("shard", "s").count(), "mix-counts")
    drawn = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("count").alias("n")).collect()}
    over = [max(drawn.get(k, 0) - q, 0) for k, q in enumerate(quotas)]
    short = [max(q - drawn.get(k, 0), 0) for k, q in enumerate(quotas)]
    earlier = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "s", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "s").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["shard", "s"]).withColumn(
        "q", (F.col("offset") + F.col("r")).cast("long")
    )
    quota = F.get(long_array(quotas), F.col("s"))
    spare = F.get(long_array([sum(over[:k]) for k in range(len(over))]), F.col("s")) + F.col("q") - quota
    excess = F.col("q") >= quota
    ranked = ranked.withColumn("spare", F.when(excess, spare))
    heir = count_below(list(accumulate(short)), F.col("spare"), including=True)
    first_spare = [sum(short[:k]) for k in range(len(short))]
    moved = ranked.withColumn("heir", F.when(F.col("spare").isNotNull(), heir)).select(
        "shard", "slot", F.coalesce("heir", "s").alias("s"),
        F.when(
            F.col("heir").isNotNull(),
            F.get(long_array([drawn.get(k, 0) for k in range(len(quotas))]), F.col("heir"))
            + F.col("spare") - F.get(long_array(first_spare), F.col("heir")),
        ).otherwise(F.col("q")).alias("q"),
    ).withColumn("n", F.get(long_array(plan.blocks), F.col("s")))
    epoch = F.floor(F.col("q") / F.col("n")).cast("long")
    return moved.withColumn("epoch", epoch).select(
        "shard", "slot", "s", "epoch",
        permuted(F.col("q") % F.col("n"), F.col("n"), F.lit(seed), F.col("s"), F.col("epoch")).alias("block"),
    )


def with_index(placed: DataFrame, plan: Plan) -> DataFrame:
    """``placed`` with the source's index s; names are looked up in a constant map."""
    names = [n for n in plan.names if n is not None]
    position = F.array_position(F.array(*map(F.lit, names)), F.col("source")) - 1 if names else F.lit(None)
    return placed.withColumn("s", F.coalesce(position, F.lit(len(names))).cast("int"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, Plan]:
    """(spans, placed, plan): spans have shard, slot, doc_id, s, start, epoch, first_word and n_words.

    A span is the part of a document that the block in a slot holds. (s, start) names a document with words.
    """
    placed = stored(placed_documents(docs, keys), "mix-places")
    plan = plan_sources(placed, block)
    placed = with_index(placed, plan)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.filter("size > 0").select(
        "doc_id", "s", "start", "size", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block")
    ).select(
        "doc_id", "s", "start", "block",
        F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("start")).alias("first_word"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
         - F.greatest(F.col("start"), F.col("block") * block)).alias("n_words"),
    )
    spans = draw_slots(docs.sparkSession, plan, seed).join(pieces, ["s", "block"]).select(
        "shard", "slot", "doc_id", "s", "start", "epoch", "first_word", "n_words"
    )
    return spans, placed, plan


def mixed_sizes(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken (words the mix takes)."""
    spans, placed, plan = mix(docs, block, seed)
    taken = spans.groupBy("s", "start").agg(F.sum("n_words").alias("words"))
    target = F.split(F.lit(",".join(map(repr, plan.targets or [0.0]))), ",").cast("array<double>")
    joined = placed.alias("p").join(
        taken.alias("t"),
        (F.col("p.s") == F.col("t.s")) & (F.col("p.start") == F.col("t.start")) & (F.col("p.size") > 0), "left",
    )
    return joined.select(
        "doc_id", "size", F.get(long_array(plan.sizes), F.col("p.s")).alias("source_size"),
        F.get(target, F.col("p.s")).alias("target"), F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source",
    )


def mixed_texts(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row per document and epoch, its text the words taken, in order.

    A document taken whole keeps its text as it is. Documents without words are not taken. Every row has its own
    place, which finds its text by a 128-bit hash of all columns; rows that are equal in all of them share a text.
    """
    content = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashes = [F.xxhash64(F.lit(k), *content) for k in (1, 2)]
    keys = ("mix_key", "mix_key_2")
    keyed = docs.select("doc_id", "source", "text", *[h.alias(k) for h, k in zip(hashes, keys, strict=True)])
    spans, placed, _ = mix(keyed, block, seed, keys)
    rows = spans.groupBy("s", "start", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"), F.sum("n_words").alias("taken")
    )
    rows = rows.join(placed.select("s", "start", "size", *keys).filter("size > 0"), ["s", "start"]).select(
        *keys, "size", "spans", "taken"
    )
    texts = docs.select(F.struct("*").alias("d"), *[h.alias(k) for h, k in zip(hashes, keys, strict=True)]).dropDuplicates(list(keys))
    joined = texts.join(rows, list(keys)).select("d", "spans", (F.col("taken") == F.col("size")).alias("is_whole"))
    cut = joined.withColumn("words", F.when(~F.col("is_whole"), words_of(F.col("d.text"))))
    spans = F.transform("spans", lambda x: F.slice(F.col("words"), (x["first_word"] + 1).cast("int"), x["n_words"].cast("int")))
    taken = cut.select("d", F.when(F.col("is_whole"), F.col("d.text")).otherwise(F.array_join(F.flatten(spans), " ")).alias("taken"))
    return taken.select(*[
        F.col("taken").alias("text") if c == "text"
        else F.length("taken").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"d.`{c}`").alias(c) for c in docs.columns
    ])
