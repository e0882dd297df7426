"""Detection metrics from TP / FP / FN rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_counts(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    def count(kind: str) -> Column:
        return F.count_if(F.col("result") == kind).alias(kind.lower())

    return outcomes.groupBy(*keys).agg(count("TP"), count("FP"), count("FN"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 (zero-safe, three decimals, half-even) and support."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return (counts.withColumn("precision", F.bround(p, 3)).withColumn("recall", F.bround(r, 3))
            .withColumn("f1", F.bround(_ratio(2 * p * r, p + r), 3)).withColumn("support", tp + fn))


def score(outcomes: DataFrame, by: str, keys: Sequence[str] = (), total: str = "overall") -> DataFrame:
    """Metrics per ``by`` and over all of it, per configuration ``keys``, in one pass.

    The overall row comes from the grouping set, not from a sum of rounded rows.
    """
    sets = [[*keys, by], list(keys)]
    counts = outcomes.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]]
    ).agg(F.count_if(F.col("result") == "TP").alias("tp"),
          F.count_if(F.col("result") == "FP").alias("fp"),
          F.count_if(F.col("result") == "FN").alias("fn"),
          F.grouping(by).alias("__all"))
    named = counts.withColumn(by, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(by)))
    return with_metrics(named.drop("__all"))


def relation_confusion(truth: DataFrame, observed: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """TP/FP/FN/TN for every scene of the truth table and relation of the vocabulary."""
    grid = truth.select("scene").distinct().withColumn(
        "relation", F.explode(F.array(*[F.lit(v) for v in vocabulary])))
    in_truth = truth.select("scene", "relation").distinct().withColumn("in_truth", F.lit(True))
    seen = observed.select("scene", "relation").distinct().withColumn("observed", F.lit(True))
    both = grid.join(in_truth, ["scene", "relation"], "left").join(seen, ["scene", "relation"], "left")
    t, o = F.coalesce("in_truth", F.lit(False)), F.coalesce("observed", F.lit(False))
    result = F.when(t & o, "TP").when(t, "FN").when(o, "FP").otherwise("TN")
    return both.select("scene", "relation", t.alias("in_truth"), o.alias("observed"),
                       result.alias("result"))


def dominance(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the best of A and B beside C, and whether C is at least as good.

    ``flags``: keys, condition, detected (boolean).
    """

    def best(condition: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("condition") == condition,
                                       F.col("detected").cast("int"))), F.lit(0))

    wide = flags.groupBy(*keys).agg(best("A").alias("a"), best("B").alias("b"), best("C").alias("c"))
    return wide.withColumn("dominates", F.col("c") >= F.greatest("a", "b"))


def leaderboard(scores: DataFrame, name: Sequence[str]) -> DataFrame:
    """Ordered by F1, then precision, then name."""
    return scores.orderBy(F.desc("f1"), F.desc("precision"), *name)


def best_with_ties(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """All configurations of each group that reach its best (f1, precision)."""
    top = scores.groupBy(*group).agg(F.max(F.struct("f1", "precision")).alias("__top"))
    return scores.join(top, list(group)).where(
        F.struct("f1", "precision") == F.col("__top")).drop("__top")


def ranked(scores: DataFrame, group: Sequence[str], name: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(F.desc("f1"), F.desc("precision"), *name)
    return scores.withColumn("place", F.row_number().over(window))


def ablation(scores: DataFrame, keys: Sequence[str], flag: str,
             metrics: Sequence[str] = ("f1", "precision", "recall")) -> DataFrame:
    """Metric with an option minus the metric without it, per key."""

    def at(metric: str, value: bool) -> Column:
        return F.max(F.when(F.col(flag) == F.lit(value), F.col(metric)))

    return scores.groupBy(*keys).agg(*[
        F.round(at(m, True) - at(m, False), 3).alias(f"{m}_delta") for m in metrics])
