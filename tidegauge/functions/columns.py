"""Expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSEEN = "__unseen__"
EPSILON = 1e-4


def bucket_of(value: Column, edges: Column) -> Column:
    """Number of edges at or below ``value``: 0 underflow, ``size(edges)`` overflow; the last edge belongs to the last bin."""
    last = F.try_element_at(edges, F.lit(-1))
    return F.when(value == last, F.size(edges) - 1).otherwise(F.size(F.filter(edges, lambda e: e <= value)))


def fine_bucket(value: Column, edges: Column, parts: int = 16, bucket: Column | None = None) -> Column:
    """A refinement of :func:`bucket_of` that rises with ``value``: even parts of each bin, and parts of growing width of the two open ends.

    It names the bucket several times: a column that holds it already spares searching the edges for each.
    """
    b, n = bucket_of(value, edges) if bucket is None else bucket, F.size(edges)
    at = lambda i: F.try_element_at(edges, i)
    lo, hi = at(F.lit(1)), at(F.lit(-1))
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    far = lambda d: F.least(F.lit(parts - 1), F.floor(4 * F.log2(1 + d / span)))
    inside = F.least(F.lit(parts - 1), F.floor(F.coalesce(F.try_divide(parts * (value - at(b)), at(b + 1) - at(b)), F.lit(0.0))))
    sub = F.when(F.isnan(value), parts - 1).when(n == 0, 0).when(b == 0, parts - 1 - far(lo - value)).when(b == n, far(value - hi)).otherwise(inside)
    return (b * parts + sub).cast("int")


def dense(counts: Column, buckets: Column) -> Column:
    """A map bucket -> count as an array over all buckets."""
    return F.transform(F.sequence(F.lit(0), buckets - 1), lambda i: F.coalesce(F.element_at(counts, i), F.lit(0).cast("long")))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _shares(counts: Column) -> Column:
    n = total(counts)
    return F.transform(counts, lambda c: c / n)


def psi(baseline: Column, live: Column) -> Column:
    """Population stability index of two count arrays, both floored at EPSILON."""
    floored = lambda c: F.transform(_shares(c), lambda p: F.greatest(p, F.lit(EPSILON)))
    return total(F.zip_with(floored(baseline), floored(live), lambda b, p: (p - b) * F.log(p / b)))


def jsd(baseline: Column, live: Column) -> Column:
    """Jensen-Shannon divergence, base 2, in [0, 1]."""

    def term(b, p):
        m = (b + p) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (half(b) + half(p)) / 2

    return total(F.zip_with(_shares(baseline), _shares(live), term))


def chi_square(baseline: Column, live: Column) -> Column:
    """Chi-square statistic of the 2 x k table, without empty columns and without continuity correction."""
    nb, nl = total(baseline), total(live)

    def term(b, p):
        col = b + p
        eb, el = col * nb / (nb + nl), col * nl / (nb + nl)
        return F.when(col > 0, (b - eb) * (b - eb) / eb + (p - el) * (p - el) / el).otherwise(F.lit(0.0))

    return total(F.zip_with(baseline, live, term))


def filled_columns(baseline: Column, live: Column) -> Column:
    return F.size(F.filter(F.zip_with(baseline, live, lambda b, p: b + p), lambda c: c > 0))


def python_str(c: Column, dtype: str) -> Column:
    """``str(v)`` of a value: booleans as True and False."""
    return F.when(c, "True").when(~c, "False") if dtype == "boolean" else c.cast("string")


def plain_text(x: Column, digits: int = 5) -> Column:
    """``x`` to at most 5 ``digits``, in the text of SQL's cast: no exponent from 0.0001 on, and half away from zero once scaled (0.000565 is 56.49... and so 0.00056)."""
    units = F.round(x * 10**digits)
    fixed = F.regexp_replace((units / 10**digits).cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")
    small = (units != 0) & (F.abs(units) < 10 ** (digits - 4))
    return F.when(small, F.concat(units.cast("long").cast("string"), F.lit(f"e-{digits:02d}"))).otherwise(fixed)


def fingerprint(*columns: str) -> Column:
    """sha256 of the named columns, in name order; equal rows have equal fingerprints."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
