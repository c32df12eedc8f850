"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document's statistics.  Documents with equal votes are counted together; the
label model of ``quality`` (expectation-maximisation over these counts, at most 3 to the number of rules) estimates
how often each rule is right, and the posterior probability of good, a sum of a term for each rule, replaces the
demand that all rules pass.

Words are runs of anything but the six ASCII white-space characters.  Windows of three words are compared by 64-bit
hashes, each with its position, within one text only.

Defined cases: a null text has no words and fails the base test; a null id is carried along; equal rows give equal
results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.quality import ABSTAIN, BAD, GOOD, LabelModel
from docengine.llm.store import Store

#: Fixed values of the base statistics.
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHOUTS = "!?^~"
MARKS = SYMBOLS + SHOUTS + "=+_/\\@{}[]"
MARKED_WORD = r"[#*$%&|<>!?^~](?=[ \t\n\x0b\f\r]|\z)"

#: Documents of fewer words draw no vote.
FEWEST_WORDS = 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _occurrences(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """One row for each document (``doc_id``, ``text``) with its base statistics and those that rules need besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES + " ", "")) > 0)
    split = docs.select(
        F.col("doc_id").cast("long"),
        words(text).alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, SPACES + " ", "")).cast("long").alias("word_chars"),
        _occurrences(text, SYMBOLS).alias("n_symbols"),
        _occurrences(text, CAPITALS).alias("n_capitals"),
        _occurrences(text, SHOUTS).alias("n_shouts"),
        _occurrences(text, MARKS).alias("n_marks"),
        F.regexp_count(text, F.lit(MARKED_WORD)).cast("long").alias("n_marked_words"),
    )
    counted = split.select(
        "doc_id", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_marks", "n_marked_words",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # windows of three words, by hash
        F.when(F.size("words") >= 4, F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    ordered = counted.withColumn("windows", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # a window that has an equal neighbour in this order is found twice or more
    found = F.filter("windows", lambda x, i: (F.get("windows", i - 1)["h"] == x["h"]) | F.coalesce(F.get("windows", i + 1)["h"] == x["h"], F.lit(False)))
    starts = ordered.withColumn("starts", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("windows")
    # each start covers three words, or those up to the next start
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(F.col("n_words") < FEWEST_WORDS, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The vote of each rule."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per_word = lambda name: F.col(name) / n

    def below(value: Column, good: float, bad: float) -> Column:
        return _vote(value, value > bad, value <= good)

    capitals = F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))
    marks = F.col("n_marks") / F.greatest(F.col("word_chars"), F.lit(1))
    length = F.col("word_chars") / n
    variety = F.col("n_distinct_words") / F.sqrt(2.0 * n)
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": below(per_word("n_symbols"), 0.05, 0.3),
        "marks": below(marks, 0.03, 0.1),
        "marked_words": below(per_word("n_marked_words"), 0.05, 0.3),
        "capitals": below(capitals, 0.15, 0.5),
        "shouts": below(per_word("n_shouts"), 0.1, 0.4),
        "repeats": below(per_word("n_repeat_words"), 0.1, 0.3),
        "lines": F.when(F.col("n_lines") < 3, ABSTAIN).otherwise(below(lines, 0.1, 0.4)),
        "variety": _vote(variety, variety < 2.0, variety >= 2.5),
        "length": _vote(length, (length < 2) | (length > 20), length.between(3, 12)),
    }


def probability(model: LabelModel, votes: list[Column]) -> Column:
    """The label model's posterior of good, as one expression."""
    prior = math.log(model.prior / (1 - model.prior))
    odds: Column = F.lit(prior)
    for j, vote in enumerate(votes):
        term = [float(math.log(g / b)) for b, g in zip(model.rates[0][j], model.rates[1][j])]
        odds = odds + F.when(vote == BAD, term[0]).when(vote == GOOD, term[2]).otherwise(term[1])
    silent = F.lit(True)
    for vote in votes:
        silent = silent & (vote == ABSTAIN)
    return 1 / (1 + F.exp(-F.when(silent, prior).otherwise(odds)))


def judge(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """For each document its statistics, votes, the probability of good, and whether it is kept: the base test passed
    and the probability at least ``least``."""
    stats = Store(docs.sparkSession, "rules").put(statistics(docs), "statistics")
    voted = stats.select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in rules().items()])
    names = [f"vote_{k}" for k in rules()]
    table = np.array([tuple(r) for r in voted.groupBy(*names).count().collect()], np.int64).reshape(-1, len(names) + 1)
    model = LabelModel().fit(table[:, :-1], table[:, -1].astype(float))
    if not len(model.rates[0]):
        return voted.limit(0).select("*", F.lit(0.0).alias("probability"), base_failed().alias("base_failed"), F.lit(False).alias("kept"))
    p = probability(model, [F.col(c) for c in names])
    return voted.select("*", p.alias("probability"), base_failed().alias("base_failed"), (~base_failed() & (p >= least)).alias("kept"))
