"""Windows, segments, and tables of literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import Model, interval
from tidegauge.functions.columns import python_str


def with_window(df: DataFrame, at: str, duration: str) -> DataFrame:
    """Adds ``window_start`` and ``window_end`` of the epoch-aligned, half-open window of event time ``at``."""
    w = F.window(F.col(at), interval(duration))
    return df.withColumn("window_start", w["start"]).withColumn("window_end", w["end"])


def window_grid(spark, start, end, duration: str) -> DataFrame:
    """Every window that meets ``[start, end)``, whether or not data exist."""
    step = F.expr(f"interval {interval(duration)}")
    bounds = spark.range(1).select(F.lit(start).cast("timestamp").alias("s"), F.lit(end).cast("timestamp").alias("e"))
    first = F.window(F.col("s"), interval(duration))["start"]
    bounds = bounds.where("s < e").select(first.alias("first"), "e")
    return bounds.select(F.explode(F.sequence("first", F.greatest("first", F.col("e") - F.expr("interval 1 microsecond")), step)).alias("window_start")).select(
        "window_start", (F.col("window_start") + step).alias("window_end")
    )


def in_range(df: DataFrame, start, end, at: str) -> DataFrame:
    """Half-open range of event time."""
    bound = lambda x: F.lit(x).cast("timestamp").cast(dict(df.dtypes)[at])
    return df.where((F.col(at) >= bound(start)) & (F.col(at) < bound(end)))


def windows_meeting(df: DataFrame, start, end) -> DataFrame:
    return df.where((F.col("window_end") > F.lit(start).cast("timestamp")) & (F.col("window_start") < F.lit(end).cast("timestamp")))


def calendar_range(first_day: str, last_day: str) -> tuple[Column, Column]:
    """Half-open range of the days from the first to the last, both whole."""
    return F.to_timestamp(F.lit(first_day)), F.date_add(F.to_date(F.lit(last_day)), 1).cast("timestamp")


def chosen(at: str, options: list[tuple[list[int], Column]], dtype: str) -> Column:
    """The value of the option that lists the number in column ``at``, or null."""
    out = F.when(F.lit(False), F.lit(None).cast(dtype))
    for numbers, value in options:
        out = out.when(F.col(at).isin(numbers), value)
    return out


def listed(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows known beforehand, as literals: no Python worker starts for them."""
    names = [c.split(":")[0].strip() for c in schema.split(",")]
    structs = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs).cast(f"array<struct<{schema}>>")))


def slices(df: DataFrame, model: Model) -> DataFrame:
    """Each row once for the whole and once for each non-null segment value; not a cube.

    Rows are multiplied by numbers, from which dimension and value follow: an array of structs would be built anew for each.
    """
    kinds = dict(df.dtypes)
    dims = list(enumerate(model.segment_dimensions, 1))
    out = df.withColumn("_s", F.explode(F.lit(list(range(len(dims) + 1)))))
    names, values = [([i], F.lit(d)) for i, d in dims], [([i], python_str(F.col(d), kinds[d])) for i, d in dims]
    out = out.withColumns({"segment_dimension": chosen("_s", names, "string"), "segment_value": chosen("_s", values, "string")})
    return out.where("_s = 0 or segment_value is not null").drop("_s")
