"""Naive Bayes over coded attributes, without smoothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class NaiveBayes:
    """prior (label, p) and cond (attr, value, label, p); attribute values are compared as text."""

    attrs: list[str]
    prior: DataFrame
    cond: DataFrame


def fit(df: DataFrame, attrs: Sequence[str], label: str) -> NaiveBayes:
    """Relative frequencies; rows with a NULL label are left out, a NULL value of an attribute is no value."""
    df = df.filter(F.col(label).isNotNull())
    lab = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    prior = lab.join(F.broadcast(lab.agg(F.sum("n").alias("t"))), how="inner").select("label", (F.col("n") / F.col("t")).alias("p"))  # one row
    # one row per distinct combination first, so the unpivot multiplies combinations, not rows
    combos = df.groupBy(F.col(label).cast("string").alias("label"), *[F.col(a).cast("string").alias(a) for a in attrs]).agg(F.count("*").alias("_c"))
    long = combos.unpivot(["label", "_c"], list(attrs), "attr", "value").filter(F.col("value").isNotNull())
    n = long.groupBy("attr", "value", "label").agg(F.sum("_c").alias("m"))
    cond = n.join(lab, "label").select("attr", "value", "label", (F.col("m") / F.col("n")).alias("p"))
    return NaiveBayes(list(attrs), prior, cond)


def predict(df: DataFrame, model: NaiveBayes, most_cells: int = 100_000) -> DataFrame:
    """``df`` with ``pred``: the label of the greatest prior times product of conditionals, the smallest on ties.

    A value never seen with a label makes that label's product 0.  The model
    (at most ``most_cells`` probabilities, else ValueError) becomes one
    expression, so prediction is a projection without a join.
    """
    prior = {r["label"]: r["p"] for r in model.prior.collect()}
    cells = model.cond.limit(most_cells + 1).collect()
    if len(cells) > most_cells:
        raise ValueError(f"more than {most_cells} probabilities")
    table: dict = {}
    for r in cells:
        table.setdefault((r["label"], r["attr"]), {})[r["value"]] = r["p"]
    scores = []
    for lab in sorted(prior):
        p = F.lit(prior[lab])
        for a in model.attrs:
            m = table.get((lab, a), {})
            look = F.create_map(*[F.lit(x) for kv in sorted(m.items()) for x in kv]) if m else None
            p = p * (F.coalesce(F.element_at(look, F.col(a).cast("string")), F.lit(0.0)) if m else F.lit(0.0))
        scores.append(F.struct(p.alias("p"), F.lit(lab).alias("label")))
    best = F.reduce(F.array(*scores[1:]), scores[0], lambda b, x: F.when(x["p"] > b["p"], x).otherwise(b)) if len(scores) > 1 else scores[0]
    return df.withColumn("_best", best).withColumn("pred", F.col("_best.label")).drop("_best")
