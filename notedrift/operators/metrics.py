"""Classification and regression metrics (J19, J20) as aggregations.

Macro F1 is the unweighted mean of per-class F1 (Spark's evaluator ``f1`` is
the weighted one, so it is not used here).  A class that never occurs in the
predictions or the labels still counts, with F1 = 0 when it has no true
positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = (),
              times: str | None = None) -> DataFrame:
    """(by..., label, prediction, n); a row stands for ``times`` rows."""
    return df.groupBy(*by, label, prediction).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           by: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """Accuracy and macro F1 per group ``by`` (one row per group)."""
    by = list(by)
    cm = confusion(df, label, prediction, by, times)
    tp = cm.filter(F.col(label) == F.col(prediction)).groupBy(*by, F.col(label).alias("cls")).agg(F.sum("n").alias("tp"))
    support = cm.groupBy(*by, F.col(label).alias("cls")).agg(F.sum("n").alias("n_true"))
    predicted = cm.groupBy(*by, F.col(prediction).alias("cls")).agg(F.sum("n").alias("n_pred"))
    per = (support.join(predicted, [*by, "cls"], "full").join(tp, [*by, "cls"], "left")
           .fillna(0, subset=["tp", "n_true", "n_pred"]))
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / (F.col("n_true") + F.col("n_pred")))
    per = per.withColumn("f1", f1)
    agg = per.groupBy(*by).agg(F.sum("tp").alias("_tp"), F.sum("n_true").alias("_n"), F.avg("f1").alias("f1_macro"))
    return agg.select(*by, (F.col("_tp") / F.col("_n")).alias("accuracy"), "f1_macro")


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error."""
    e = (F.col(prediction).cast("double") - F.col(label).cast("double")) ** 2
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.sqrt(F.avg(e)).alias("rmse"))
