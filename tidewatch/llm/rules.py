"""Quality classifier: a sparse ensemble of rules over text statistics.

Paths of small trees become conjunctive rules, a logistic regression with a lasso penalty weighs
them, and the rules that keep a weight are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.storage import staged

STATISTICS = [
    "chars", "words", "lines", "word_chars", "longest_word", "distinct_words", "distinct_lines", "upper",
    "capitalised", "digits", "marks", "pipes", "shouts", "symbols", "sentence_ends",
]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``stats`` of text statistics; a null text counts as empty.

    All but the counts are shares of the characters, words or lines, and 0 for an empty text.
    """
    kept = F.struct("*").alias("row")
    split = docs.select(kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    split = split.withColumn("_words", F.filter(F.split("_text", r"\s+"), lambda w: w != ""))
    split = split.withColumn("_lines", F.split("_text", "\n"))

    def hits(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern)).cast("double")

    chars = F.greatest(F.length("_text"), F.lit(1)).cast("double")
    words = F.greatest(F.size("_words"), F.lit(1)).cast("double")
    lines = F.size("_lines").cast("double")
    longest = F.coalesce(F.array_max(F.transform("_words", lambda w: F.length(w))), F.lit(0))
    values = {
        "chars": F.length("_text").cast("double"), "words": F.size("_words").cast("double"), "lines": lines,
        "word_chars": F.length("_text") / words, "longest_word": longest.cast("double"),
        "distinct_words": F.size(F.array_distinct("_words")) / words,
        "distinct_lines": F.size(F.array_distinct("_lines")) / lines,
        "upper": hits(r"\p{Lu}") / chars, "capitalised": hits(r"(?<![^\s])\p{Lu}") / words,
        "digits": hits(r"\p{N}") / chars, "marks": hits(r"[^\s\p{L}\p{N}]") / chars,
        "pipes": hits(r"\|") / words, "shouts": hits(r"!") / words, "symbols": hits(r"[#$%&*@^~<>{}]") / words,
        "sentence_ends": hits(r"[.!?](?=\s|$)") / words,
    }
    stats = F.struct(*[values[k].alias(k) for k in STATISTICS])
    return split.select("row", stats.alias("_stats")).select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c != "stats"], F.col("_stats").alias("stats")
    )


@dataclass(frozen=True)
class Rule:
    """``low < statistic <= high`` for each bound: (statistic, low, high), None for an open end."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, stats: str = "stats") -> Column:
        test = F.lit(True)
        for name, low, high in self.bounds:
            value = F.col(f"{stats}.{name}")
            if low is not None:
                test &= value > F.lit(low)
            if high is not None:
                test &= value <= F.lit(high)
        return test


@dataclass(frozen=True)
class RuleModel:
    """Weights of the rules that the lasso kept, and the intercept."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total += F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The path to every node of a tree, from Spark's indented description of it."""
    rules, path = [], []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not found:
            continue
        indent, feature, sign, value = len(found[1]), names[int(found[2])], found[3], float(found[4])
        path = [step for step in path if step[0] < indent] + [(indent, feature, sign, value)]
        bounds: dict[str, tuple[float | None, float | None]] = {}
        for _, name, way, at in path:
            low, high = bounds.get(name, (None, None))
            if way == "<=":
                high = at if high is None else min(high, at)
            else:
                low = at if low is None else max(low, at)
            bounds[name] = (low, high)
        rules.append(Rule(tuple((name, *bounds[name]) for name in sorted(bounds))))
    return rules


def fit(
    rows: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 2e-4, seed: int = 7,
) -> RuleModel:
    """Fit on ``stats, label`` (labels 0 and 1; other rows are ignored).  All labelled rows are used.

    With rows of one label only, or none, every text gets the share of label 1 (a half if none).
    """
    rows = staged(rows.filter(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("double").alias("label")), "labelled")
    n, share = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        share = 0.5 if not n else min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), ())
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", seed=seed, minInstancesPerNode=2
    ).fit(rows.select("label", array_to_vector(F.array(*[F.col(f"stats.{k}") for k in STATISTICS])).alias("features")))
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString, STATISTICS)}, key=lambda r: repr(r.bounds))
    if not rules:
        return RuleModel(math.log(share / (1 - share)), ())
    fired = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    fired = staged(fired, "fired")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(fired)
    kept = [(rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9]
    return RuleModel(float(lasso.intercept), tuple(kept))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` alone: a narrow table, so that texts need not be moved to their labels."""
    return statistics(docs.select("doc_id", "text")).select("doc_id", "stats")


def scored(docs: DataFrame, model: RuleModel, into: str = "score") -> DataFrame:
    """``docs`` with the score in ``into``; null and empty texts are scored by their (zero) statistics.

    A column of that name in ``docs`` is replaced, other columns stay.
    """
    row = docs.select(F.struct("*").alias("row"), "text")
    found = statistics(row).select("row", model.score().alias("_score"))
    return found.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c != into], F.col("_score").alias(into)
    )


def fit_labelled(stats: DataFrame, labels: DataFrame, learn: Column, **options) -> RuleModel:
    """Fit on the rows of ``stats`` (doc_id, stats) for which ``learn`` holds and ``labels`` (doc_id, label) has a label.

    A doc_id that has both labels teaches nothing; repeated equal labels count once.
    """
    agreed = (
        labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    )
    return fit(stats.filter(learn).join(agreed, "doc_id").select("stats", "label"), **options)
