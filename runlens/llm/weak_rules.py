"""Quality by weak supervision: rules vote good (1) or bad (-1) or abstain (0), expectation-maximisation estimates how far
each rule is to be believed in either class, and the posterior probability decides.

All of it is DataFrame expressions. The corpus enters the estimation as counts of vote patterns (at most 3 to the number of
rules), so a round of it is one aggregation over a small table and one row of sums comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from ..plans.rows import project_where

SYMBOLS = "#*$%&|<>"
RULES = ["symbols", "capitals", "word_length", "same_lines", "repeats", "shouts", "no_sentences", "prose"]
NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_stops"]


def _with(rows: DataFrame, **new: Column) -> DataFrame:
    """Rows with new columns that are computed once, however often they are used."""
    return project_where(rows, F.lit(True), *[F.col(c) for c in rows.columns], *[v.alias(k) for k, v in new.items()])


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of NUMBERS for every row; a null text has no words. Windows are compared by 64-bit hash."""
    rows = common.texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _with(rows, words=F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    w = F.col("words")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))) \
        .otherwise(F.array().cast("array<long>"))
    rows = _with(rows, windows=windows, lines=F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
    h = F.col("windows")
    rows = _with(rows, ordered=F.when(F.size(F.array_distinct(h)) < F.size(h),
                                     F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("ordered")
    again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    rows = _with(rows, starts=F.array_sort(F.transform(again, lambda x: x["i"])))
    p = F.col("starts")
    reach = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    text, lines = F.col("text"), F.col("lines")
    return rows.select(
        "doc_id", F.size(w).cast("long").alias("n_words"), (F.length(text) - _without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"), F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        _without(text, "!").cast("long").alias("n_shouts"), _without(text, ".!?").cast("long").alias("n_stops"))


def votes(rows: DataFrame) -> DataFrame:
    """One column of votes per rule, from the measures. Shares are per word; a text without words gets no vote.

    Each kind of junk has a rule that calls it bad or abstains, as lack of one kind says nothing of the others; one rule
    calls plain prose good.
    """
    per = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    capitals = F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))
    some = F.col("n_words") > 0
    bad = {
        "symbols": per("n_symbols") > 0.2, "capitals": capitals > 0.4, "word_length": ~per("word_chars").between(2, 15),
        "same_lines": F.col("n_dup_lines") > 0.5 * F.col("n_lines"), "repeats": per("n_repeat_words") > 0.3,
        "shouts": per("n_shouts") > 0.2, "no_sentences": (F.col("n_words") >= 50) & (per("n_stops") < 0.01),
    }
    prose = per("n_stops").between(0.01, 0.5) & (per("n_symbols") <= 0.05) & (per("n_shouts") < 0.02) & (capitals < 0.15) & (per("n_repeat_words") < 0.3)
    return rows.withColumns({k: F.when(some & c, -1).otherwise(0) for k, c in bad.items()} | {"prose": F.when(some & prose, 1).otherwise(0)})


def _posterior(prior: float, accuracy: dict[str, float]) -> Column:
    """P(good | votes). accuracy: how often a rule's vote is right; abstaining says nothing."""
    good, bad = F.lit(prior), F.lit(1 - prior)
    for rule, a in accuracy.items():
        vote = F.col(rule)
        good = good * F.when(vote == 1, a).when(vote == -1, 1 - a).otherwise(1.0)
        bad = bad * F.when(vote == -1, a).when(vote == 1, 1 - a).otherwise(1.0)
    return good / (good + bad)


def estimate(voted: DataFrame, prior: float = 0.5, start: float = 0.85, weight: float = 10, rounds: int = 12) -> Column:
    """P(good | votes) after expectation-maximisation of the rules' accuracies over all rows' votes.

    prior is the class balance before any vote; start and weight are the accuracy a rule is given beforehand and how many
    votes that counts for.
    """
    patterns = common.cut(voted.groupBy(*RULES).agg(F.count("*").alias("n")))
    accuracy = dict.fromkeys(RULES, start)
    for _ in range(rounds):
        scored = patterns.select(*RULES, "n", _posterior(prior, accuracy).alias("p"))
        right = lambda r: F.when(F.col(r) == 1, F.col("p")).when(F.col(r) == -1, 1 - F.col("p")).otherwise(0.0) * F.col("n")
        got = scored.agg(*[F.coalesce(F.sum(right(r)), F.lit(0.0)).alias(r) for r in RULES],
                         *[F.coalesce(F.sum(F.when(F.col(r) != 0, F.col("n"))), F.lit(0)).alias(f"{r}_n") for r in RULES]).first()
        accuracy = {r: (got[r] + start * weight) / (got[f"{r}_n"] + weight) for r in RULES}
    return _posterior(prior, accuracy)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, posterior, kept.

    Null, empty and blank texts have no words and fail; repeated rows are judged each; extra columns are left behind; an
    empty table gives none.
    """
    voted = votes(common.cut(measures(docs)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("posterior", estimate(voted.filter("n_words > 0"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior")
