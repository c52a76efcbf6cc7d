"""Quality scores from a sparse rule ensemble.

Shallow trees are grown on labelled statistics of texts; every path from a root is a conjunctive rule. A logistic model
with a lasso penalty weighs the rules and drops most of them, and what is left is compiled into one column expression: scoring
a corpus is a projection over its statistics.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.quality_rules import add_statistics
from tablegauge.llm.shared import pick, staged

# Most labelled rows that a fit reads; beyond it, the rows with the smallest hash of their doc_id are taken.
LABELLED_ROWS = 50_000
THRESHOLD = 0.3
TREES, DEPTH, LEAST_ROWS, PENALTY, SEED = 24, 3, 15, 0.001, 7


def _per(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """What rules may speak of: statistics of the text alone."""
    return {
        "words": F.col("n_words").cast("double"), "word_length": _per("word_chars", "n_words"),
        "symbols": _per("n_symbols", "n_words"), "doubled_lines": _per("n_dup_lines", "n_lines"),
        "repeated": _per("n_repeat_words", "n_words"), "capitals": _per("n_upper", "n_letters"),
        "bare": _per("n_bare", "n_words"), "loud": _per("n_loud", "n_words"), "distinct": _per("n_distinct", "n_words"),
        "variety": F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))),
        "line_words": _per("n_words", "n_lines"), "letters": _per("n_letters", "word_chars"),
    }


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, threshold): above its threshold, or at most it."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        holds = F.lit(True)
        for name, above, threshold in self.conditions:
            holds = holds & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
        return F.when(holds, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 over the columns of ``features``."""
        odds = F.lit(self.intercept)
        for rule, weight in self.weights:
            odds = odds + weight * rule.column()
        return 1 / (1 + F.exp(-odds))


def paths(description: str, names: list[str]) -> set[Rule]:
    """Rules of a tree from Spark's description of it: each path from the root, simplified."""
    lines = re.findall(r"^( +)(?:If|Else) \(feature (\d+) (<=|>) ([-\dE.+]+)\)", description, re.M)
    found, trail = set(), []
    depths = {indent: depth for depth, indent in enumerate(sorted({indent for indent, *_ in lines}, key=len))}
    for indent, feature, sign, threshold in lines:
        del trail[depths[indent]:]
        trail.append((names[int(feature)], sign == ">", float(threshold)))
        tightest: dict[tuple[str, bool], float] = {}
        for name, above, value in trail:
            known = tightest.get((name, above), value)
            tightest[name, above] = max(known, value) if above else min(known, value)
        found.add(Rule(tuple(sorted((name, above, value) for (name, above), value in tightest.items()))))
    return found


def fit(labelled: DataFrame) -> RuleModel:
    """Fit on a table of features and ``label`` (0 or 1). With one class or no rows the score is the smoothed share of 1."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(features())
    ones, rows = labelled.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1))).first()
    prior = math.log((ones + 1) / (rows - ones + 1))
    if ones in (0, rows):
        return RuleModel(prior, ())
    table = VectorAssembler(inputCols=names, outputCol="features").transform(labelled)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, seed=SEED,
                                    featureSubsetStrategy="onethird", maxBins=64).fit(table)
    rules = sorted(set().union(*(paths(tree.toDebugString, names) for tree in forest.trees)), key=lambda r: (len(r.conditions), r.conditions))
    if not rules:
        return RuleModel(prior, ())
    ruled = labelled.select("label", *[rule.column().alias(f"r{i}") for i, rule in enumerate(rules)])
    ruled = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(ruled)
    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=100, standardization=False).fit(ruled)
    weights = [(rule, float(w)) for rule, w in zip(rules, lasso.coefficients) if abs(w) > 1e-6]
    return RuleModel(float(lasso.intercept), tuple(weights))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are read only for rows that are not held out, at most LABELLED_ROWS of them. NULL and empty texts have zero
    statistics and are scored like any other; NULL ids have no label. Labels that are NULL, unknown to ``docs`` or repeated are
    left out, do nothing, or count as often. No rows give no rows; other columns are ignored, whatever their names.
    """
    counted = add_statistics(pick(docs, "doc_id", "text"), "text").drop("text")
    table = staged(counted.select("doc_id", *[column.alias(name) for name, column in features().items()]), "features")
    known = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    total = known.count()
    if total > LABELLED_ROWS:
        share = int(LABELLED_ROWS / total * 0.98 * 2**31)
        known = known.where(F.xxhash64("doc_id", F.lit(SEED)).bitwiseAND(F.lit(2**31 - 1)) < share)
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label")).hint("merge")
    sample = table.join(known, F.col("doc_id") == F.col("_id")).select("label", *features())
    model = fit(staged(sample, "labelled"))
    scored = table.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
