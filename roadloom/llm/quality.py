"""Document quality by a sparse rule ensemble.

Statistics of each text are Spark expressions. Trees grown on a bounded sample of labelled rows give
conjunctive rules; a lasso logistic fit keeps few of them; the kept rules and their weights are compiled
into one Spark column, so scoring a corpus is a projection without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm import trees
from roadloom.llm.common import crc32_text, words

#: Labelled rows that a fit reads at most, those of the least hashes of their ids.
MAX_TRAIN = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.002, 7

STATISTICS = ("log_words", "word_chars", "long_words", "distinct", "adjacent", "upper", "symbols", "pipes", "exclaim", "digits", "stops", "lines", "short_share")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus one double column ``q_<name>`` for each of ``STATISTICS``; defined for empty and null texts."""
    d = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("_words", words(F.col("_text")))
    d = d.withColumn("_n", F.greatest(F.size("_words"), F.lit(1)).cast("double")).withColumn("_chars", F.greatest(F.length("_text"), F.lit(1)).cast("double"))
    per = lambda p: F.regexp_count("_text", F.lit(p)) / F.col("_chars")
    return d.withColumns(
        {
            "q_log_words": F.log1p(F.size("_words").cast("double")),
            "q_word_chars": F.length(F.array_join("_words", "")) / F.col("_n"),
            "q_long_words": F.expr("size(filter(_words, w -> length(w) > 24))") / F.col("_n"),
            "q_distinct": F.size(F.array_distinct("_words")) / F.col("_n"),
            "q_adjacent": F.expr("size(filter(_words, (w, i) -> i > 0 AND w = _words[i - 1]))") / F.col("_n"),
            "q_upper": per(r"\p{Lu}"),
            "q_symbols": per(r"[#*$%&<>@^~_=+\\]"),
            "q_pipes": per(r"[|]"),
            "q_exclaim": per(r"[!?]"),
            "q_digits": per(r"[0-9]"),
            "q_stops": per(r"[.,;:]"),
            "q_lines": F.regexp_count("_text", F.lit("\n")) / F.col("_n"),
            # a value per row that a filter on the score cannot be pushed below, where it would compute the statistics once per rule
            "q_row": F.monotonically_increasing_id(),
            "q_short_share": F.expr("size(filter(_words, w -> length(w) <= 3))") / F.col("_n"),
        }
    ).drop("_text", "_words", "_n", "_chars")


@dataclass
class RuleModel:
    """Rules with their weights; ``prior`` alone where there was nothing to learn from."""

    bias: float
    rules: list[tuple[trees.Condition, ...]]
    weights: list[float]

    def column(self) -> F.Column:
        names = [f"q_{x}" for x in STATISTICS]
        logit = reduce(lambda a, b: a + b, (F.when(trees.rule_column(r, names), w).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)), F.lit(self.bias))
        return 1 / (1 + F.exp(-logit))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, seed: int = SEED) -> RuleModel:
    """Learn from at most ``max_train`` labelled rows; labels other than 0 and 1 and rows without a text are ignored."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    # broadcast: max_train rows of two numbers
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(marked), "_id").where("_t IS NOT NULL")
    # of rows that share an id one is learned from, always the same
    names = [f"q_{x}" for x in STATISTICS]
    one = statistics(known, "_t").groupBy("_id").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), *names, F.col("_y").cast("double").alias("y"))).alias("m"))
    data = np.array(sorted(tuple(r) for r in one.select(*(f"m.{x}" for x in names), "m.y").collect()), float).reshape(-1, len(STATISTICS) + 1)
    x, y = data[:, :-1], data[:, -1]
    if len(y) == 0:
        return RuleModel(0.0, [], [])
    prior = (y.sum() + 1) / (len(y) + 2)
    base = math.log(prior / (1 - prior))
    if y.min() == y.max():
        return RuleModel(base, [], [])
    grown = trees.forest(x, y, TREES, DEPTH, seed, features=5)
    rules = list(dict.fromkeys(r for t in grown for r in trees.paths(t)))
    bias, w = trees.lasso_logistic(trees.rule_values(rules, x), y, PENALTY)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(bias, [rules[k] for k in kept], [float(w[k]) for k in kept])


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score``, the likelihood of label 1. A null text scores as an empty one."""
    return statistics(docs, text_col).withColumn("score", F.when(F.col("q_row") >= 0, model.column())).drop("q_row", *(f"q_{x}" for x in STATISTICS))


def in_training(id_col: str) -> F.Column:
    """Rows that may be learned from: all but those whose id's CRC-32 leaves 1 when divided by 3."""
    return crc32_text(F.col(id_col)) % 3 != 1


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``held_out``, ``score`` and ``predicted``.

    Fitted on labelled rows that are not held out; of an id with several labels the larger counts, of rows that
    share an id one is learned from. Null ids are held out; null, empty and very long texts are scored whole;
    repeated rows are kept; without usable labels every score is 0.5; columns of these names are replaced; an
    empty table gives an empty result.
    """
    d = docs.drop("held_out", "score", "predicted")
    model = fit(d.where(in_training(id_col)), labels.where(in_training(id_col)), id_col, text_col)
    out = score(d, model, text_col)
    return out.withColumn("held_out", ~F.coalesce(in_training(id_col), F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
