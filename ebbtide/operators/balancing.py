"""Synthetic minority rows between true nearest neighbours, one rule at every size."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.neighbours import nearest
from ebbtide.session import stored


def oversample(
    train: DataFrame, label: str = "label", k: int = 5, features: str = "features"
) -> DataFrame:
    """Training rows plus synthetic rows that bring every class to the largest class's size.

    A minority row moves a random share of the way to one of its k nearest neighbours in its class. New rows are
    dealt to the minority rows evenly, the remainder in the order of their hashes; all draws are hashes of the
    row's values, so a repeated task repeats them. Equal rows are told apart by their number among their equals.
    """
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    largest = max(counts.values())
    out = train.select(features, label)
    for code, n in sorted(counts.items()):
        if n < largest and n > 1:
            rows = _synthetic(train.where(F.col(label) == code), n, largest, max(1, min(n - 1, k)), features)
            out = out.unionByName(
                rows.select(array_to_vector("v").alias(features), F.lit(code).alias(label))
            )
    return out


def _draw(tag: str, *cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(tag), *cols), F.lit(1 << 53)) / float(1 << 53)


def _synthetic(minority: DataFrame, n: int, target: int, k: int, features: str) -> DataFrame:
    values = minority.select(vector_to_array(features).alias("v"))
    twin = F.row_number().over(Window.partitionBy("v").orderBy("v"))
    rows = stored(values.withColumn("twin", twin).withColumn("id", F.xxhash64("v", "twin")), "minority")
    each, more = divmod(target - n, n)
    first = rows.orderBy("id").limit(more).select("id").withColumn("extra", F.lit(1))  # the share of new rows that is left
    dealt = rows.join(first, "id", "left").withColumn("times", F.lit(each) + F.coalesce("extra", F.lit(0))).filter("times > 0")
    near = nearest(rows.select("id", "v"), k)
    base = dealt.join(near, "id").select("id", "v", "neighbours", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    place = F.floor(_draw("partner", F.col("id"), F.col("copy")) * F.size("neighbours")).cast("int")
    chosen = base.select("id", "v", "copy", F.get("neighbours", place)["id"].alias("to")).join(
        rows.select(F.col("id").alias("to"), F.col("v").alias("w")), "to"
    )
    share = _draw("share", F.col("id"), F.col("copy"))
    return chosen.select(F.zip_with("v", "w", lambda a, b: a + share * (b - a)).alias("v"))
