"""Row validation against a declared schema; errors are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import Model

#: The texts of errors below.


def _json_kind(parsed: Column, name: str) -> Column:
    """string, number, boolean, null or other of one top-level value; null when the key is absent."""
    v = F.try_variant_get(parsed, f"$['{name}']", "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "number").otherwise("other")
    )


def feature_errors(text: Column, parsed: Column, model: Model) -> Column:
    """``array<string>`` of what is wrong with a row's JSON object of features, given as text and as a variant."""
    declared = F.array(*[F.lit(f.name) for f in model.features])
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    unknown = F.array_sort(F.array_except(keys, declared))
    found = [F.when(F.size(unknown) > 0, F.concat(F.lit("unknown features: ['"), F.array_join(unknown, "', '"), F.lit("']")))]
    for f in model.features:
        kind = _json_kind(parsed, f.name)
        missing = kind.isNull() | (kind == "null")
        if f.dtype == "continuous":
            bad = F.when(kind != "number", f"feature '{f.name}' must be numeric")
        else:
            bad = F.when(~kind.isin("string", "boolean"), f"feature '{f.name}' must be a string or boolean")
        found.append(F.when(missing, None if f.nullable else f"feature '{f.name}' is required").otherwise(bad))
    return F.array_compact(F.array(*found))


def validated(df: DataFrame, model: Model, features: str = "features") -> DataFrame:
    """``df`` with ``errors`` added; a row is good when it is empty."""
    # Each text is parsed once, and every feature read from the variant.
    return df.withColumn("_parsed", F.try_parse_json(F.col(features))).withColumn("errors", feature_errors(F.col(features), F.col("_parsed"), model)).drop("_parsed")
