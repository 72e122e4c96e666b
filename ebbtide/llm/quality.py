"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic classifier gives each document evidence from its own measures. Grouped sums of that evidence give
each host and each path (section of a host) a posterior share of good documents, a path shrunk towards its
host and a host towards the global share; how strongly is estimated from the spread between the groups (method
of moments). A document's own evidence then meets the prior of its path, its own part in that prior left out.

The classifier is fitted on at most ``sample`` labelled documents, taken in the order of a hash of their ids and
held by the driver; everything else covers all documents. Groups are joined back on (host, path), one row per
group, and hot hosts are summed map-side.

Defined results: a null or empty text has zero measures and is judged like any other; null hosts and languages
are groups of their own; labels that are null or contradict each other are not used; without labels of both
kinds every document's evidence is 0; repeated rows are judged each; other columns pass through ``accepted`` and
are not read elsewhere; an empty table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import stored, text_of, without_rows
from ebbtide.llm.quality_rules import measures

SAMPLE = 20_000
THRESHOLD = 0.5


def evidence_features() -> list[Column]:
    """Measures of a document on comparable scales."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    symbols, upper = F.col("n_symbols") / chars, F.col("n_upper_words") / n
    repeats, lines, distinct = F.col("n_repeat_words") / n, F.col("n_dup_lines") / n, F.col("n_distinct") / n
    return [
        F.lit(1.0), F.log(n), (F.log(n) < math.log(10)).cast("double"), chars / n / 10,
        F.least(symbols * 20, F.lit(3.0)), (symbols > 0.05).cast("double"),
        F.least(upper * 3, F.lit(3.0)), (upper > 0.25).cast("double"),
        repeats, (repeats > 0.5).cast("double"), F.least(lines * 20, F.lit(3.0)),
        distinct, F.log(F.greatest(F.col("n_distinct"), F.lit(1))) / F.log(n + 1), (distinct < 0.15).cast("double"),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method with an L2 penalty."""
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (y - p) - ridge * weights
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def labelled_sample(labels: DataFrame, column: str, sample: int) -> DataFrame:
    """doc_id and y of at most ``sample`` documents with one label, in the order of a hash."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(
        F.min(column).alias("y"), F.max(column).alias("top")
    ).filter("y = top")
    return one.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(bounded / (1 - bounded))


def _concentration(spread: float | None, share: float) -> float:
    """Pseudo-documents of a Beta prior with mean ``share`` and the variance found between groups."""
    variance = max(spread or 0.0, 1e-6)
    return min(1e4, max(2.0, share * (1 - share) / variance - 1))


def score(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
    sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, host, path, evidence (log-odds), host_share, path_share, posterior and keep of every document.

    By default the host is the source and the path its section of one language, as in the pages' addresses
    (``pages_site`` gives both for an address).
    """
    return judged_rows(docs, labels, host, path, sample, threshold).drop("row_key")


def row_key(host: Column, path: Column) -> Column:
    """Hash of all that a verdict depends on: equal rows have equal verdicts."""
    return F.xxhash64(text_of(F.col("text")), host, host.isNull(), path, path.isNull())


def judged_rows(
    docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, sample: int, threshold: float
) -> DataFrame:
    """The columns of ``score`` and each row's key."""
    host = (F.col("source") if host is None else host).cast("string")
    path = (F.col("lang") if path is None else path).cast("string")
    keyed = docs.select(
        F.struct(F.col("doc_id"), host.alias("host"), path.alias("path"), row_key(host, path).alias("row_key")).alias("doc_id"), "text"
    )
    measured = stored(
        measures(keyed).select("doc_id.*", F.array(*evidence_features()).alias("x")), "quality-measures"
    )
    # of several rows of one id, the least by its measures: a row per label, the same in every run
    rows = measured.join(labelled_sample(labels, "quality", sample), "doc_id").groupBy("doc_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y")
    ).orderBy("doc_id").select("x", "y").toArrow()
    y = rows["y"].to_numpy().astype(float)
    base = 0.5
    weights = np.zeros(len(evidence_features()))
    if len(set(y)) == 2:
        x = np.array(rows["x"].to_pylist())
        weights, base = fit_logistic(x, y), float(y.mean())
    linear = sum((F.get(F.col("x"), k) * float(w) for k, w in enumerate(weights)), F.lit(0.0))
    judged = measured.select("doc_id", "host", "path", "row_key", linear.alias("logit")).withColumn(
        "p", 1 / (1 + F.exp(-F.col("logit")))
    )

    groups = stored(judged.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("squares")
    ), "quality-groups")
    hosts = groups.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum("squares").alias("host_squares"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    share = (total["good"] or 0.0) / total["n"] if total["n"] else base
    share = min(1 - 1e-6, max(1e-6, share))

    def spread(n: str, good: str, squares: str, centre: Column) -> Column:
        """Variance between groups: of their shares, less what chance within groups explains."""
        own = F.col(good) / F.col(n)
        within = F.col(squares) / F.col(n) - own * own
        return F.sum(F.col(n) * (own - centre) * (own - centre) - within) / F.sum(n)

    k_host = _concentration(hosts.agg(spread("host_n", "host_good", "host_squares", F.lit(share))).first()[0], share)
    sites = groups.alias("g").join(hosts.alias("h"), F.col("g.host").eqNullSafe(F.col("h.host"))).select(
        F.col("g.host").alias("site_host"), F.col("g.path").alias("site_path"), "n", "good", "squares", "host_n", "host_good"
    )
    k_path = _concentration(sites.agg(spread("n", "good", "squares", F.col("host_good") / F.col("host_n"))).first()[0], share)

    joined = judged.join(
        sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    )
    host_share = (F.col("host_good") - F.col("p") + k_host * share) / (F.col("host_n") - 1 + k_host)
    path_share = (F.col("good") - F.col("p") + k_path * F.col("host_share")) / (F.col("n") - 1 + k_path)
    odds = F.col("logit") - math.log(base / (1 - base)) + _logit(F.col("path_share"))
    return joined.withColumn("host_share", host_share).withColumn("path_share", path_share).select(
        "doc_id", "host", "path", F.col("logit").alias("evidence"), "host_share", "path_share",
        (1 / (1 + F.exp(-odds))).alias("posterior"), "row_key",
    ).withColumn("keep", F.col("posterior") >= threshold)


def pages_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address."""
    return (
        F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1),
        F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([^/?#]*)", 1),
    )


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, all their columns; every row is judged, those of one id or without an id too."""
    judged = judged_rows(docs, labels, None, None, sample, threshold)
    key = row_key(F.col("source").cast("string"), F.col("lang").cast("string"))
    return without_rows(docs, judged.filter(~F.col("keep")).select("doc_id", "row_key"), key)
