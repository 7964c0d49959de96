"""Evaluation reports of classifiers and recommenders, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, obs: str = "obs", pred: str = "pred", dense: bool = True) -> DataFrame:
    """(pred, obs, n).  ``dense``: every pair of observed labels has a row; predictions of a label never observed have none."""
    n = df.groupBy(F.col(pred).cast("string").alias("pred"), F.col(obs).cast("string").alias("obs")).agg(F.count("*").alias("n"))
    if not dense:
        return n
    labels = df.agg(F.array_sort(F.collect_set(F.col(obs).cast("string"))).alias("_l"))  # one row
    cells = labels.select(F.explode("_l").alias("pred"), "_l").select("pred", F.explode("_l").alias("obs"))
    return cells.join(n, ["pred", "obs"], "left").select("pred", "obs", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(df: DataFrame, labels: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(pred).cast("string").alias("pred")).pivot(obs, labels).count().fillna(0)


def overall(df: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    """One row: n, correct, accuracy, error.  A NULL prediction is wrong."""
    hit = F.coalesce((F.col(obs).cast("string") == F.col(pred).cast("string")).cast("long"), F.lit(0))
    a = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("correct"))
    acc = F.try_divide(F.col("correct").cast("double"), F.col("n"))
    return a.select("n", "correct", acc.alias("accuracy"), (1 - acc).alias("error"))


def per_class(df: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn, tn, precision, recall, pf, f) of every observed label.

    A ratio with denominator 0 is 1; f is NULL where precision and recall are 0.
    Predictions of labels never observed count in no cell.
    """
    c = confusion(df, obs, pred)
    by_pred = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("as_pred"), F.sum(F.when(F.col("pred") == F.col("obs"), F.col("n")).otherwise(0)).alias("tp"))
    by_obs = c.groupBy(F.col("obs").alias("label")).agg(F.sum("n").alias("as_obs"))
    total = c.agg(F.sum("n").alias("total"))
    j = by_pred.join(by_obs, "label").join(F.broadcast(total), how="inner")  # one row
    j = j.select("label", "tp", (F.col("as_pred") - F.col("tp")).alias("fp"), (F.col("as_obs") - F.col("tp")).alias("fn"), (F.col("total") - F.col("as_pred") - F.col("as_obs") + F.col("tp")).alias("tn"))

    def ratio(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(1.0))

    j = j.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "pf": ratio("fp", "tn")})
    return j.withColumn("f", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(df: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    return overall(df, obs, pred).select("accuracy")


def fold_report(df: DataFrame, obs: str = "obs", pred: str = "pred", fold: str = "fold") -> DataFrame:
    """One row: pooled_accuracy over all rows and mean_accuracy over the folds."""
    hit = F.coalesce((F.col(obs).cast("string") == F.col(pred).cast("string")).cast("double"), F.lit(0.0))
    f = df.groupBy(fold).agg(F.sum(hit).alias("hit"), F.count("*").alias("n"))
    return f.agg(F.try_divide(F.sum("hit"), F.sum("n")).alias("pooled_accuracy"), F.avg(F.col("hit") / F.col("n")).alias("mean_accuracy"))


def author_report(df: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    """(author, hits, strikes, misses, precision, recall, f1); an author never predicted has NULL strikes, precision and f1."""
    hit = (F.col(obs) == F.col(pred)).cast("long")
    a = df.groupBy(F.col(obs).alias("author")).agg(F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses"))
    b = df.groupBy(F.col(pred).alias("author")).agg(F.sum(1 - hit).alias("strikes"))
    j = a.join(b, "author", "full_outer")
    p = F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("strikes"))
    r = F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses"))
    j = j.withColumns({"precision": p, "recall": r})
    return j.select("author", "hits", "strikes", "misses", "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def cf_report(df: DataFrame, rating: str = "rating", pred: str = "pred", threshold: float = 5.0) -> DataFrame:
    """One row: tp, fp, fn, tn of "rating >= threshold", precision, recall (1 if undefined), f1 (0 if undefined), accuracy, mae.  NULL counts as below; mae skips NULLs."""
    o, p = F.coalesce(F.col(rating) >= threshold, F.lit(False)), F.coalesce(F.col(pred) >= threshold, F.lit(False))
    c = df.agg(
        F.count_if(o & p).alias("tp"), F.count_if(~o & p).alias("fp"), F.count_if(o & ~p).alias("fn"), F.count_if(~o & ~p).alias("tn"), F.avg(F.abs(F.col(rating) - F.col(pred))).alias("mae")
    )
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(1.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(1.0))
    c = c.withColumns({"precision": prec, "recall": rec, "accuracy": F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
