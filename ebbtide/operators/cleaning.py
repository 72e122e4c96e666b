"""Row filters of the three raw logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import specs
from ebbtide.operators.quantiles import quantile_values
from ebbtide.session import stored

#: Stands for a missing time, before all others; the panels take unix seconds below 10^12.
NO_TIME = -(10**13)


def drop_missing_text(reviews: DataFrame, col: str = "Text") -> DataFrame:
    return reviews.dropna(subset=[col])


def valid_scores(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("Score").between(1, 5))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate rather than a window: copies are combined before the shuffle, so a text repeated
    in a third of the rows does not pile up in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    first = df.groupBy(*keys).agg(F.min(ranked).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])


def dedupe_reviews(reviews: DataFrame, text_key: str = "Text") -> DataFrame:
    """Drop repeated (product, user, text) reviews.

    ``text_key`` may name a key of the text so that long texts need not be shuffled.
    """
    return keep_first(reviews, ["ProductId", "UserId", text_key], ["Time"])


def first_ratings(reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``keep_first`` by time gives for rows of keys, ``Time`` and a whole ``Score`` from 1 to 5.

    Time and score are ordered as one number, whose minimum is combined in hash tables; a struct's would sort all rows.
    """
    packed = F.coalesce(F.col("Time"), F.lit(NO_TIME)).cast("bigint") * 8 + F.col("Score")
    first = reviews.groupBy(*keys).agg(F.min(packed).alias("_first"))
    time, score = F.shiftright("_first", 3), F.pmod("_first", F.lit(8))
    found = {"Time": F.when(time != NO_TIME, time), "Score": score}
    return first.select(*[F.col(c) if c in keys else found[c].cast(reviews.schema[c].dataType).alias(c) for c in reviews.columns])


def clean_reviews(reviews: DataFrame, text_key: str = "Text") -> DataFrame:
    valid = valid_scores(drop_missing_text(reviews, text_key))
    keys = ["ProductId", "UserId", text_key]
    whole = all(isinstance(valid.schema[c].dataType, T.IntegralType) for c in ("Time", "Score"))
    if whole and set(valid.columns) == {*keys, "Time", "Score"}:
        return first_ratings(valid, keys)
    return dedupe_reviews(valid, text_key)


def valid_sales(sales: DataFrame) -> DataFrame:
    """Known customer, not cancelled, positive quantity and price."""
    return sales.where(
        F.col("CustomerID").isNotNull()
        & ~F.col("Invoice").cast("string").startswith("C")
        & (F.col("Quantity") > 0)
        & (F.col("Price") > 0)
    )


def below_quantile(df: DataFrame, col: str, p: float = 0.999) -> DataFrame:
    """Rows strictly below the exact p-quantile of the column."""
    return df.where(F.col(col) < F.lit(quantile_values(df, [(col, p)])[(col, p)]))


def clean_sales(sales: DataFrame, p: float = 0.999) -> DataFrame:
    """Valid sales, cut at the quantity quantile and then at the price quantile of what is left.

    The valid rows are stored once: both quantiles and the result read them instead of the joined log.
    """
    valid = stored(valid_sales(sales), "valid-sales")
    return below_quantile(below_quantile(valid, "Quantity", p), "Price", p)


def valid_events(events: DataFrame) -> DataFrame:
    """Known product and user, an event type of the funnel, positive price."""
    return events.dropna(subset=["product_id", "user_id"]).where(
        F.col("event_type").isin(*specs.EVENT_WEIGHTS) & (F.col("price") > 0)
    )


def clean_events(events: DataFrame, p: float = 0.999) -> DataFrame:
    return below_quantile(valid_events(events), "price", p)


def products_with_rows(df: DataFrame, id_col: str, minimum: int) -> DataFrame:
    """Rows of products with at least ``minimum`` rows.

    Counting combines map-side; the semi join may be split by adaptive execution on hot products.
    """
    enough = df.groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    return df.join(enough, id_col, "left_semi")


def products_with_periods(df: DataFrame, id_col: str, period: str, minimum: int) -> DataFrame:
    """Rows of products seen in at least ``minimum`` distinct periods."""
    enough = (
        df.groupBy(id_col)
        .agg(F.countDistinct(period).alias("_n"))
        .where(F.col("_n") >= minimum)
    )
    return df.join(enough, id_col, "left_semi")
