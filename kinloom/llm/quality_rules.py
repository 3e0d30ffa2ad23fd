"""Quality rules as weak supervision.

Each rule votes good (1), bad (0) or abstains.  The distinct vote patterns of all documents are
counted (3^rules of them at most: 177,147), expectation-maximisation on the counts estimates how often each
rule votes which way on good and on bad documents, and a document is kept by its posterior
probability of being good.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kinloom.llm._spark import checkpointed
from kinloom.llm.text_stats import with_counts

ROUNDS = 60
KEEP_FROM = 0.5
#: What rules are taken to do before any vote is seen: P(vote bad) on good and on bad documents.
ALARM, HIT = 0.02, 0.4
#: Weight of that prior as a share of the documents, and in documents at least.
STRENGTH, LEAST_PRIOR = 0.2, 2.0


@dataclass
class Rule:
    """good and bad are conditions; bad wins where both hold, null counts as not holding."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(F.coalesce(self.bad, F.lit(False)), 0).when(F.coalesce(self.good, F.lit(False)), 1).otherwise(2)


def default_rules() -> list[Rule]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    some = F.col("n_words") > 0
    return [
        Rule("length", F.col("n_words") >= 50, F.col("n_words") < 20),
        Rule("word_length", per("word_chars", "n_words").between(3, 10), some & ~per("word_chars", "n_words").between(2, 14)),
        Rule("symbols", some & (per("n_symbols", "n_words") < 0.02), per("n_symbols", "n_words") > 0.1),
        Rule("dup_lines", (F.col("n_lines") > 2) & (per("n_dup_lines", "n_lines") < 0.05), per("n_dup_lines", "n_lines") > 0.3),
        Rule("repeats", (F.col("n_words") >= 20) & (per("n_repeat_words", "n_words") < 0.05), per("n_repeat_words", "n_words") > 0.3),
        Rule("letters", per("n_letter_words", "n_words") >= 0.9, some & (per("n_letter_words", "n_words") < 0.7)),
        Rule("capitals", (F.col("n_lower") > 0) & (F.col("n_upper") < 0.2 * F.col("n_lower")), F.col("n_upper") > F.col("n_lower")),
        Rule("letter_share", some & (per("n_letters", "word_chars") >= 0.9), some & (per("n_letters", "word_chars") < 0.8)),
        Rule("short_words", (F.col("n_words") >= 20) & per("n_short_words", "n_words").between(0.15, 0.6), (F.col("n_words") >= 20) & ~per("n_short_words", "n_words").between(0.1, 0.7)),
        Rule("bars", some & (F.col("n_bars") == 0), per("n_bars", "n_words") > 0.2),
        Rule("line_ends", (F.col("n_lines") > 0) & (per("n_ended_lines", "n_lines") > 0.6), (F.col("n_lines") > 2) & (per("n_ended_lines", "n_lines") < 0.1)),
    ]


def estimate(patterns: list[list[int]], counts: list[int], rounds: int = ROUNDS, alarm: float = ALARM, hit: float = HIT, strength: float = STRENGTH) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of good documents and P(vote | class) as [class, rule, vote].

    Starts from 80 percent good documents and rules that seldom vote bad on good documents
    (``alarm``) and often enough on bad ones (``hit``): each rule looks for one kind of fault, so
    most are silent on any one bad document.  The start is kept as a prior that weighs as much as
    ``strength`` times the documents.
    """
    votes, weight = np.array(patterns), np.array(counts, float)
    m, total = votes.shape[1], weight.sum()
    abstain = np.array([(weight * (votes[:, j] == 2)).sum() / total for j in range(m)])
    start = np.array([[bad * (1 - abstain), (1 - bad) * (1 - abstain), abstain] for bad in (hit, alarm)]).transpose(0, 2, 1)
    given, good, prior = start.copy(), 0.8, max(LEAST_PRIOR, strength * total)
    for _ in range(rounds):
        post = posterior(votes, good, given)
        for c, p in ((0, 1 - post), (1, post)):
            for v in range(3):
                given[c, :, v] = ((weight * p)[:, None] * (votes == v)).sum(axis=0) + prior * start[c, :, v]
            given[c] /= given[c].sum(axis=1, keepdims=True)
        good = ((weight * post).sum() + 0.8 * prior) / (total + prior)
    return float(good), given


def posterior(votes: np.ndarray, good: float, given: np.ndarray) -> np.ndarray:
    logs = np.log(np.clip(given, 1e-9, 1))
    places = np.arange(votes.shape[1])
    odds = np.log(good) - np.log(1 - good) + (logs[1, places, votes] - logs[0, places, votes]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge_quality(docs: DataFrame, rules: list[Rule] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the counts, votes, posterior, base_failed, kept.

    Null and empty texts have no words: base_failed is true and kept false.  The estimates are
    made from the votes of all documents; an empty table gives an empty result.  Repeated rows are
    judged alike and each counts.  Other columns are not read.
    """
    rules = default_rules() if rules is None else rules
    counted = checkpointed(with_counts(docs, ["doc_id"]).withColumn("votes", F.concat(*[r.vote().cast("string") for r in rules])))
    seen = counted.groupBy("votes").count().collect()  # 3^rules rows at most
    if not seen:
        return counted.select("*", F.lit(0.0).alias("posterior"), F.lit(True).alias("base_failed"), F.lit(False).alias("kept"))
    good, given = estimate([[int(v) for v in r["votes"]] for r in seen], [r["count"] for r in seen])
    logs = np.log(np.clip(given, 1e-9, 1))
    # the posterior's log odds are a sum over votes, so they compile into one expression
    odds = F.lit(float(np.log(good) - np.log(1 - good)))
    for j in range(len(rules)):
        vote = F.substring("votes", j + 1, 1)
        gain = [float(logs[1, j, v] - logs[0, j, v]) for v in range(3)]
        odds = odds + F.when(vote == "0", gain[0]).when(vote == "1", gain[1]).otherwise(gain[2])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counted.withColumns({"posterior": 1 / (1 + F.exp(-odds)), "base_failed": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
