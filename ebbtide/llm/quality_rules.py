"""Quality rules under weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every document is voted on by ``rules()``: 1 for good, 0 for bad, null to abstain. A rule votes one way only,
so votes have at most 2 ** 8 patterns, counted over all documents. Expectation-maximisation
over that table estimates the share of good documents and, per rule and class, how often it votes each way;
the posterior of a document is then one native expression over its votes.

Defined results: a null or empty text has no words, fails the base rule (fewer than 10 words) and isn't kept;
null ids are kept as they are; repeated rows count and are judged each; an empty table gives an empty result;
other columns are not read. Very long texts are read whole, with working memory in proportion to the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import let, stored, text_of, window_hashes, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_distinct")


def _covered(hashes: Column) -> Column:
    """Number of words inside windows whose hash occurs again, overlaps counted once."""
    none = F.lit(None).cast("int")

    def again(placed: Column) -> Column:
        return F.sort_array(F.array_compact(F.transform(placed, lambda x, k: F.when(
            (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]), x["i"]
        ).otherwise(none))))

    def span(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(placed, again), span)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measured columns of each document."""
    text = text_of(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        words_of(F.col("text")).alias("w"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("[A-Z][A-Z]+")).cast("long").alias("n_upper_words"),
    )
    hashed = base.select(
        "doc_id", "n_symbols", "n_dup_lines", "n_upper_words",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("w"),
    ).select("*", window_hashes(F.col("w"), WINDOW).alias("h")).withColumn(
        "n_distinct", F.size(F.array_distinct("w")).cast("long")
    )
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    return hashed.select(
        "doc_id", *[c for c in FEATURES if c != "n_repeat_words"],
        F.when(repeated, _covered(F.col("h"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Vote of each rule: 0 against the document, 1 for it, null to abstain."""
    n, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    upper, repeats, lines = F.col("n_upper_words"), F.col("n_repeat_words"), F.col("n_dup_lines")
    few = F.col("n_distinct") < 200
    against = {
        "length": n < 10,
        "word_length": (chars < 2 * n) | (chars > 16 * n),
        "symbols": 12 * symbols > chars,
        "lines": 25 * lines > n,
        "repeats": 100 * repeats > 20 * n,
        "capitals": 4 * upper > n,
        "variety": few & (20 * F.col("n_distinct") < 3 * n),
    }
    prose = (n >= 10) & (30 * symbols <= chars) & (100 * repeats <= 20 * n) & (10 * upper <= n) & (25 * lines <= n)
    votes = {name: F.when(bad, F.lit(0)) for name, bad in against.items()}
    return votes | {"prose": F.when(prose, F.lit(1))}


def fit(patterns: list[tuple[tuple, int]], rounds: int = 50, prior: float = 0.85) -> tuple[float, list[dict]]:
    """EM over (votes, documents) rows: share of good documents, and per rule the log-odds of good by vote.

    A vote of a rule has a probability per class, abstention included. At first good documents draw few votes
    against (2 %) and many for (90 %), bad ones 25 % and 20 %. Counts are smoothed by those first rates with
    the weight of ten documents, so a rule that never errs keeps a finite weight.
    """
    first = {True: {0: 0.02, 1: 0.9}, False: {0: 0.25, 1: 0.2}}
    n_rules = len(patterns[0][0]) if patterns else 0
    kind = [max([v for votes, _ in patterns if (v := votes[j]) is not None], default=0) for j in range(n_rules)]
    rate = {good: [first[good][k] for k in kind] for good in first}
    share = prior

    def log_odds(j: int, vote: int | None) -> float:
        good, bad = rate[True][j], rate[False][j]
        return math.log((1 - good) / (1 - bad)) if vote is None else math.log(good / bad)

    for _ in range(rounds):
        cast = {True: [0.0] * n_rules, False: [0.0] * n_rules}
        mass = {True: 0.0, False: 0.0}
        for votes, n in patterns:
            odds = math.log(share / (1 - share)) + sum(log_odds(j, v) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            for good, weight in ((True, n * p), (False, n * (1 - p))):
                mass[good] += weight
                for j, v in enumerate(votes):
                    cast[good][j] += weight * (v is not None)
        share = (mass[True] + 10 * prior) / (mass[True] + mass[False] + 10)
        rate = {g: [(c + 10 * first[g][k]) / (mass[g] + 10) for c, k in zip(cast[g], kind, strict=True)] for g in first}
        # no rule is read against its meaning
        for j, k in enumerate(kind):
            low, high = sorted((rate[True][j], rate[False][j]))
            rate[True][j], rate[False][j] = (high, low) if k else (low, high)
    return share, [{v: log_odds(j, v) for v in (None, k)} for j, k in enumerate(kind)]


def judge(docs: DataFrame, rounds: int = 50, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, the votes, posterior and kept."""
    voted = stored(
        measures(docs).select("*", base_failed().alias("base_failed"), *[v.alias(f"vote_{k}") for k, v in rules().items()]),
        "rule-votes",
    )
    names = [f"vote_{k}" for k in rules()]
    counted = voted.groupBy(*names).count().collect()  # 2 ** 8 rows at most
    share, weights = fit([(tuple(r[c] for c in names), r["count"]) for r in sorted(counted, key=str)], rounds)
    odds = F.lit(math.log(share / (1 - share)))
    for name, weight in zip(names, weights, strict=False):
        vote = max(v for v in weight if v is not None)
        odds = odds + F.when(F.col(name) == vote, weight[vote]).otherwise(weight[None])
    return voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )
