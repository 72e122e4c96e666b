"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every distinct 64-bit shingle hash below a limit, one in ``ONE_IN`` of all, so a document's sketch
grows with the document and the sketch of a union is the union of sketches (``merge``). Containment of one sketch
in the smaller of two estimates how much of the smaller document the other one holds, however unequal they are.
The fingerprint of a text whose shingles all lie above the limit is its least hash, marked by ``~``: enough to tell
texts apart and compare them, but no part of a sketch, so merging never sees it. Fingerprints are the hashes'
bytes in base64.

Defined results: a null or empty text has no shingles, an empty fingerprint, likeness 1 to another such text
and 0 to any other; a text of fewer words than a shingle is one shingle; null ids come last in the order of
documents, equal ids are ordered by text; repeated rows keep a row each; other columns are not read. A single
document is its own next document. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import count_below, let, text_of, window_hashes, words_of

SHINGLE = 5
#: One in so many hashes is kept.
ONE_IN = 32
#: Documents that one window partition holds, and the most partitions asked for.
BLOCK_DOCS = 1024
MAX_BLOCKS = 16_000


def sketch(text: Column, width: int = SHINGLE, one_in: int = ONE_IN) -> Column:
    """Struct of ``kept``, the ascending distinct hashes below the limit, and ``least``, the least hash if none is kept."""
    limit = -(1 << 63) + (1 << 64) // one_in

    def retain(runs: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(runs, lambda h: h < F.lit(limit))))
        return F.struct(low.alias("kept"), F.when(F.size(low) == 0, F.array_min(runs)).alias("least"))

    def shingles(words: Column) -> Column:
        whole = F.aggregate(words, F.lit(0).cast("long"), lambda h, w: F.xxhash64(h, w))
        return F.when(F.size(words) >= width, window_hashes(words, width)).when(
            F.size(words) > 0, F.array(whole)
        ).otherwise(F.array().cast("array<bigint>"))

    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    return let(let(words, shingles), retain)


def merge(a: Column, b: Column) -> Column:
    """The kept hashes of two texts together, from their kept hashes; shingles across their border aside."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other one has too."""
    x, y = all_hashes(a), all_hashes(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(
        F.when(F.size(x) == F.size(y), 1.0).otherwise(0.0)
    ).cast("double")


def all_hashes(sketch: Column) -> Column:
    """What a text is compared by: its kept hashes, or the least one if there are none."""
    return F.when(sketch["least"].isNull(), sketch["kept"]).otherwise(F.array(sketch["least"]))


def printed(sketch: Column) -> Column:
    """Base64 of the hashes' bytes; a lone least hash has a ``~`` before it."""
    encoded = F.base64(F.unhex(F.array_join(F.transform(all_hashes(sketch), lambda h: F.lpad(F.hex(h), 16, "0")), "")))
    return F.concat(F.when(sketch["least"].isNotNull(), "~").otherwise(""), F.replace(encoded, F.lit("\r\n"), F.lit("")))


def with_next(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, Window]:
    """Rows ``doc_id, text, block, tail`` such that a window over a block sees every row's next row.

    Blocks are ranges of ids between actual ids, found by quantiles. The first rows of a block are copied to
    the end of the block before it, marked as ``tail``; those of the first block go behind the last one.
    """
    n = docs.count()
    wanted = min(MAX_BLOCKS, n // block_docs)
    shares = [k / (wanted + 1) for k in range(1, wanted + 1)]
    row = docs.agg(
        F.max("doc_id").alias("top"),
        *([F.percentile_approx("doc_id", shares, 20 * (wanted + 1)).alias("cuts")] if shares else []),
    ).first()
    top = row["top"]
    cuts = sorted({c for c in (row["cuts"] or [])} - {top}) if shares else []
    id_ = F.col("doc_id")
    block = F.when(id_.isNull(), 0).otherwise(count_below(cuts, id_))
    is_cut = F.lit(False) if not cuts else F.coalesce((id_ == F.lit(top)) | (count_below(cuts, id_, True) > block), F.lit(False))
    own = F.struct(block.alias("block"), F.lit(False).alias("tail"))
    wrap = id_.eqNullSafe(F.lit(top).cast("bigint"))
    copies = F.when(wrap, F.array(own, F.struct(F.lit(0).alias("block"), F.lit(True).alias("tail")))).when(
        is_cut, F.array(own, F.struct((block + 1).alias("block"), F.lit(True).alias("tail")))
    ).otherwise(F.array(own))
    placed = docs.select("doc_id", text_of(F.col("text")).alias("text"), F.explode(copies).alias("at")).select(
        "doc_id", "text", "at.block", "at.tail"
    )
    order = Window.partitionBy("block").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return placed, order


def fingerprint(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Fingerprints of all texts and of their edited texts; see the columns below."""
    placed, order = with_next(docs, block_docs)
    n = F.col("n_chars")
    third = F.floor(n / 3).cast("int")
    text, following = F.col("text"), F.lead("text").over(order)
    edited = placed.select("*", F.length("text").cast("long").alias("n_chars"), following.alias("after")).select(
        "doc_id", "block", "tail", "text", "n_chars",
        F.concat(text.substr(F.lit(1), (n - third).cast("int")), F.coalesce(F.col("after").substr(F.lit(1), third), F.lit(""))).alias("edited"),
    )
    sketched = edited.select(
        "doc_id", "block", "tail", F.xxhash64("text").alias("tie"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("of_edited"),
    )
    order = Window.partitionBy("block").orderBy("tail", F.col("doc_id").desc_nulls_last(), "tie")
    return sketched.withColumn("of_next", F.lead("own").over(order)).filter(~F.col("tail")).select(
        "doc_id", "n_chars", "edited_sha256",
        printed(F.col("own")).alias("fingerprint"), printed(F.col("of_edited")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("of_edited")).alias("near_edited"),
        containment(F.col("own"), F.col("of_next")).alias("near_next"),
    )
