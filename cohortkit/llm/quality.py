"""Quality scores by a sparse rule ensemble, compiled into Spark columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.session import written

# Labelled rows to fit on (expected size of the sample); trees, their depth, and the lasso penalty.
TRAIN_DOCS, TREES, DEPTH, PENALTY, STEPS = 20_000, 20, 3, 1e-3, 60
# A rule holds when each named statistic is above the low and at most the high bound.
Rule = tuple[tuple[str, float, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Named numbers of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.split(F.lower(t), " ", -1)
    lines = F.split(t, "\n", -1)

    def share(pattern: str) -> Column:
        return (chars - F.length(F.regexp_replace(t, pattern, ""))) / F.greatest(chars, F.lit(1))

    return {
        "chars": chars.cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": chars / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "lines": F.size(lines).cast("double"),
        "line_length": chars / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"[0-9]+"),
        "marks": share(r"[#$%&*@~^=+<>{}\[\]_\\/]+"),
        "bars": share(r"\|+"),
        "shouts": share(r"[!?]+"),
        "stops": share(r"[.,;:]+"),
    }


def _rules(model, names: Sequence[str]) -> list[Rule]:
    """Every path from a root to a node, as bounds per statistic; each rule once."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found.setdefault(tuple(sorted((n, *b) for n, b in bounds.items())))
        if node.subtreeDepth() == 0:
            return
        name, threshold = names[node.split().featureIndex()], float(node.split().threshold())
        low, high = bounds.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), {**bounds, name: (low, min(high, threshold))})
        walk(node.rightChild(), {**bounds, name: (max(low, threshold), high)})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def holds(rule: Rule) -> Column:
    """The rule as a condition on columns that are named as the statistics."""
    sides = [F.col(n) > low for n, low, _ in rule if low > -math.inf] + [F.col(n) <= high for n, _, high in rule if high < math.inf]
    return reduce(lambda a, b: a & b, sides)


@dataclass
class RuleEnsemble:
    """Intercept and weighted rules; the score is the logistic of their sum."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        parts = [F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.intercept))))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """Fit on a hash sample of about ``train_docs`` labelled rows of ``docs``.

    Trees are grown over the statistics; their paths become rules, and a logistic regression with lasso
    penalty keeps the few that matter. With labels of one class the score is their share, without labels 0.5.
    """
    marked = labels.select(F.col(id_col).alias("_l"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0)).dropDuplicates(["_l"])
    rows = marked.count()
    chosen = marked.where(F.pmod(F.xxhash64("_l"), F.lit(1_000_000)) < int(min(1.0, train_docs / max(rows, 1)) * 1_000_000))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stats = statistics(F.col("text"))
    table = written(texts.join(F.broadcast(chosen), F.col("id") == F.col("_l")).select("label", *[c.alias(n) for n, c in stats.items()]), "statistics")
    share = table.agg(F.avg("label").alias("p")).first().p
    if share is None or share in (0.0, 1.0):
        bounded = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return RuleEnsemble(math.log(bounded / (1 - bounded)), [])
    names = list(stats)
    features = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=1).fit(features)
    rules = _rules(forest, names)
    if not rules:
        return RuleEnsemble(math.log(share / (1 - share)), [])
    matched = table.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(matched).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=STEPS, standardization=False).fit(vectors)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def add_score(docs: DataFrame, ensemble: RuleEnsemble, name: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their score as the column ``name``, in one scan."""
    stats = statistics(F.col(text_col))
    prefixed = {f"_stat_{n}": c for n, c in stats.items()}
    renamed = RuleEnsemble(ensemble.intercept, [(tuple((f"_stat_{n}", low, high) for n, low, high in rule), w) for rule, w in ensemble.rules])
    return docs.select("*", *[c.alias(n) for n, c in prefixed.items()]).withColumn(name, renamed.score()).drop(*prefixed)


def score(docs: DataFrame, ensemble: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, score (0 to 1), predicted (1 from ``threshold``).

    Null and empty texts have the statistics of the empty text and are scored like any other. Repeated rows
    are scored one by one; an empty table gives no rows; other columns are not read.
    """
    scored = add_score(docs.select(F.col(id_col), F.col(text_col).alias("_text")), ensemble, "score", "_text")
    return scored.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
