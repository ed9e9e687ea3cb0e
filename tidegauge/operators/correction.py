"""Benjamini-Hochberg correction within groups of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(df: DataFrame, by: list[str], p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adds ``corrected_p_value`` (q) and ``passes_fdr`` to rows that have a p-value; null elsewhere.

    Groups are the tests of one window, a small number for any volume of data.
    """
    has = F.col(p).isNotNull()
    group = [*[F.col(c) for c in by], has]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(p))
    m = F.count(p).over(Window.partitionBy(*group))
    ranked = df.withColumn("_rank", rank).withColumn("_m", m).withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    above = Window.partitionBy(*group).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.lit(1.0), F.min("_raw").over(above))
    last = F.max(F.when(F.col(p) <= F.lit(alpha) * F.col("_rank") / F.col("_m"), F.col("_rank"))).over(Window.partitionBy(*group))
    return (
        ranked.withColumn("corrected_p_value", F.when(has, q))
        .withColumn("passes_fdr", F.when(has, F.coalesce(F.col("_rank") <= last, F.lit(False))))
        .drop("_rank", "_m", "_raw")
    )
