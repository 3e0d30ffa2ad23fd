"""Quality classifier: a sparse rule ensemble.

Shallow trees are grown on statistics of the texts, every path from a root to a node becomes a
conjunctive rule, a lasso logistic regression gives most rules the weight 0, and what is left is
compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from kinloom.llm._spark import checkpointed, held_out, learning_rows
from kinloom.llm.text_stats import with_counts

LEARN_FROM = 16_000
TREES = 20
DEPTH = 3
LASSO = 1e-3
THRESHOLD = 0.3


def statistics() -> dict[str, Column]:
    """The statistics that rules speak of, over the columns of ``with_counts``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.log1p("n_words"), "word_length": per("word_chars", "n_words"), "longest_word": F.col("longest_word").cast("double"),
        "symbols_per_word": per("n_symbols", "n_words"), "bars_per_word": per("n_bars", "n_words"), "bangs_per_word": per("n_bangs", "n_words"),
        "stops_per_word": per("n_stops", "n_words"), "digits_per_char": per("n_digits", "n_chars"), "upper_share": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "short_words": per("n_short_words", "n_words"), "letter_words": per("n_letter_words", "n_words"), "words_per_line": per("n_words", "n_lines"),
        "dup_lines": per("n_dup_lines", "n_lines"), "ended_lines": per("n_ended_lines", "n_lines"), "repeat_words": per("n_repeat_words", "n_words"), "seen_words": per("n_repeat_once", "n_words"),
    }


@dataclass(frozen=True)
class PathRule:
    """All of its conditions (statistic, '<=' or '>', threshold) must hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & ((F.col(name) <= at) if op == "<=" else (F.col(name) > at))
        return out


def tree_rules(node, names: list[str], path: tuple = ()) -> set[PathRule]:
    """A rule for every node under the root of a fitted tree."""
    out = {PathRule(path)} if path else set()
    if node.subtreeDepth() > 0:
        name, at = names[node.split().featureIndex()], float(node.split().threshold())
        for child, op in ((node.leftChild(), "<="), (node.rightChild(), ">")):
            # a tighter bound on the same statistic takes the place of a looser one
            kept = tuple(c for c in path if (c[0], c[1]) != (name, op))
            out |= tree_rules(child, names, (*kept, (name, op, at)))
    return out


@dataclass
class RuleEnsemble:
    rules: list[PathRule]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The compiled score, over the columns of ``statistics``."""
        odds = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            odds = odds + F.when(rule.holds(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn_from: int = LEARN_FROM, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Learn from about ``learn_from`` labelled documents that are not held out.

    Without both classes the score is the share of label 1 (a half without labels).
    """
    sample = learning_rows(docs, labels, label, learn_from)
    stats = statistics()
    names = list(stats)
    table = checkpointed(with_counts(sample, ["y"]).select(F.col("y").cast("double").alias("label"), *[e.cast("double").alias(n) for n, e in stats.items()]).coalesce(6))
    count = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("p")).first()
    n, p = count["n"], count["p"]
    if not 0 < p < n:
        share = min(max(p / n if n else 0.5, 1e-9), 1 - 1e-9)
        return RuleEnsemble([], [], math.log(share / (1 - share)))
    vector = table.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=7, minInstancesPerNode=5).fit(vector)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree._java_obj.rootNode(), names)}, key=lambda r: r.conditions)
    indicators = table.select("label", array_to_vector(F.array(*[r.holds().cast("double") for r in rules])).alias("features"))
    lasso_fit = LogisticRegression(maxIter=60, regParam=lasso, elasticNetParam=1.0, standardization=False).fit(indicators)
    kept = [(r, float(w)) for r, w in zip(rules, lasso_fit.coefficients.toArray(), strict=True) if w != 0.0]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], float(lasso_fit.intercept))


def quality(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are scored by the statistics of a text without words.  Labels, lang,
    source and doc_id are no inputs of a score.  Repeated rows are scored alike; an empty table
    gives an empty result; other columns are not read.
    """
    ensemble = fit(docs, labels, **fitting)
    counted = with_counts(docs, ["doc_id"]).select("doc_id", *[e.cast("double").alias(n) for n, e in statistics().items()])
    return counted.select("doc_id", held_out("doc_id").alias("held_out"), ensemble.score().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
