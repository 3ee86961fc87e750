"""Classification metrics of many models in one plan: unpivot, confusion counts, then small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.labels import normalise


def long_results(results: DataFrame, models: Sequence[str], gold: str = "gold_label", gold_null_as_label: bool = False) -> DataFrame:
    """(id, model, gold, pred) with normalised labels; rows without prediction are left out.

    A null gold label is left out, or is the label 'nan' with gold_null_as_label. A repeated id counts once; of rows
    that differ the one with the greatest gold label holds, then that with the greatest labels of the models in turn.
    """
    row = F.max(F.struct(F.col(gold), *(F.col(f"`{m}`") for m in models))).alias("r")
    one = results.where("id IS NOT NULL").groupBy("id").agg(row).select("id", "r.*")
    g = normalise(F.col(gold))
    g = F.coalesce(g, F.lit("nan")) if gold_null_as_label else g
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), normalise(F.col(f"`{m}`")).alias("pred")) for m in models)))
    rows = one.select("id", g.alias("gold"), pairs.alias("p")).select("id", "p.model", "gold", "p.pred")
    return rows.where("gold IS NOT NULL AND pred IS NOT NULL AND pred <> ''")


def min_support(rows: DataFrame, least: int) -> DataFrame:
    """Rows whose gold label has at least so many samples of the model."""
    counts = rows.groupBy("model", "gold").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("model", "gold")
    return rows.join(counts, ["model", "gold"], "left_semi")


def confusion(rows: DataFrame) -> DataFrame:
    """(model, gold, pred, n) over the grid of each model's labels, gold or predicted; zeros included."""
    counts = rows.groupBy("model", "gold", "pred").agg(F.count("*").alias("n"))
    labels = counts.groupBy("model").agg(F.array_union(F.collect_set("gold"), F.collect_set("pred")).alias("l"))
    grid = labels.select("model", F.explode("l").alias("gold"), "l").select("model", "gold", F.explode("l").alias("pred"))
    return grid.join(counts, ["model", "gold", "pred"], "left").fillna(0, ["n"])


def confusion_relative(cells: DataFrame, compat: bool = False) -> DataFrame:
    """Share of each gold label's row; a label without gold samples has zeros, or ones with compat."""
    total = F.sum("n").over(Window.partitionBy("model", "gold"))
    share = (F.col("n") + 1e-10) / (total + 1e-10) if compat else F.when(total > 0, F.col("n") / total).otherwise(0.0)
    return cells.select("model", "gold", "pred", share.alias("share"))


def report(rows: DataFrame) -> DataFrame:
    """(model, label, precision, recall, f1, support) of each label, gold or predicted; a division by zero gives 0."""
    counts = rows.groupBy("model", "gold", "pred").agg(F.count("*").alias("n"))
    both = counts.select("model", F.inline(F.array(F.struct(F.col("gold").alias("label"), "n", F.lit(0).cast("long").alias("p"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("n"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))))
    by = both.groupBy("model", "label").agg(F.sum("n").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("tp", "predicted"), zero), F.coalesce(F.try_divide("tp", "support"), zero)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), zero)
    return by.select("model", "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def summary(rows: DataFrame) -> DataFrame:
    """One row per model: accuracy, macro precision, recall and F1, weighted F1, samples."""
    labels = report(rows)
    by = labels.groupBy("model").agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("weighted_precision"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.sum("support").alias("samples"))
    return by


def leaderboard(rows: DataFrame, baselines: Sequence[str] = ("inferred_type",), digits: int = 9) -> DataFrame:
    """Models by macro F1, best first, ties by name; the kind tells rule baselines from models."""
    cols = [F.round(c, digits).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")]
    kind = F.when(F.col("model").isin(*baselines), "Rule").otherwise("LLM")
    return summary(rows).select("model", kind.alias("kind"), *cols, "samples").orderBy(F.desc("macro_f1"), "model")


def report_frame(rows: DataFrame, digits: int = 9) -> DataFrame:
    """The label rows with the rows accuracy (repeated in all columns), macro avg and weighted avg."""
    labels = report(rows)
    s = summary(rows)
    entry = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"))
    extra = s.select("model", "samples", "accuracy", F.inline(F.array(entry("accuracy", "accuracy", "accuracy", "accuracy"), entry("macro avg", "macro_precision", "macro_recall", "macro_f1"), entry("weighted avg", "weighted_precision", "accuracy", "weighted_f1"))))
    extra = extra.select("model", "label", "precision", "recall", "f1", F.when(F.col("label") == "accuracy", F.col("accuracy")).otherwise(F.col("samples").cast("double")).alias("support"))
    out = labels.withColumn("support", F.col("support").cast("double")).unionByName(extra)
    return out.select("model", "label", *(F.round(c, digits).alias(c) for c in ("precision", "recall", "f1", "support")))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of a column's values in order of the values, nulls left out."""
    by = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return by.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6)).orderBy("label")
