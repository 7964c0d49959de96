"""Linear classifier by batch sub-gradient descent on the hinge loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minespark.scratch import materialize, release


def fit(df: DataFrame, features: Sequence[str], label: str, rate: float, iterations: int, c: float = 2.0, start: Sequence[float] | None = None) -> list[float]:
    """Weights of the features and the bias; labels are -1 and 1.

    w <- w - rate * (w + C * sum over rows with label * (w . u) <= 1 of -label * u),
    where u is the row's features and -1.  Rows with a NULL are left out.  Every
    iteration is one aggregate of one row.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y")).dropna()
    rows = materialize(rows)
    k = len(features)
    u = [F.col(f"x{i}") for i in range(k)] + [F.lit(-1.0)]
    w = list(start) if start is not None else [-1.0] + [0.0] * k
    for _ in range(iterations):
        dot = sum((ui * F.lit(wi) for ui, wi in zip(u, w)), F.lit(0.0))
        bad = F.col("y") * dot <= 1
        g = rows.agg(*[F.coalesce(F.sum(F.when(bad, -F.col("y") * ui)), F.lit(0.0)).alias(f"g{i}") for i, ui in enumerate(u)]).first()
        w = [wi - rate * (wi + c * gi) for wi, gi in zip(w, g)]
    release(rows)
    return w


def predict(df: DataFrame, features: Sequence[str], w: Sequence[float], bias_sign: int = 1) -> DataFrame:
    """``df`` with ``pred``, the sign of the features' weighted sum plus ``bias_sign`` times the bias (-1 is what training assumes)."""
    s = sum((F.col(f) * F.lit(wi) for f, wi in zip(features, w)), F.lit(float(bias_sign) * w[-1]))
    return df.withColumn("pred", F.signum(s))
