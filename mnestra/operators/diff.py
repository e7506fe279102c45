"""Problem 3: differences between two copies of data.

Method: both copies are reduced to one row a key (with map-side combination, so
that a key that was copied a million times costs no more than any other), then
met in a null-safe full outer join on the key, and the normalised columns are
compared into an array of (field, left value, right value).

Defined results: two nulls are equal, a null and a value are not; null keys are
keys like others; rows repeated on a side count once; a column differs if any row
of a key differs from any row of the other side, so always where the rows of one
key disagree on their own side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(df: DataFrame, keys: list[Column], columns: dict[str, Column], tag: str) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    flat = df.select(*[k.alias(n) for k, n in zip(keys, names)], *[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns.values())])
    out = []
    for i in range(len(columns)):
        out += [F.min(f"c{i}").alias(f"{tag}{i}_low"), F.max(f"c{i}").alias(f"{tag}{i}_high"), F.max(F.col(f"c{i}").isNull()).alias(f"{tag}{i}_null")]
    rows = flat.groupBy(*names).agg(*out) if out else flat.distinct()
    return rows.withColumnsRenamed({n: f"{tag}_{n}" for n in names}).withColumn(f"{tag}_there", F.lit(True))


def differences(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], left_columns: dict[str, Column], right_columns: dict[str, Column]) -> DataFrame:
    """Rows (key_0, ..., side, fields) of the keys that differ.

    ``side`` is ``left`` or ``right`` for a key that only that copy holds, else
    ``both``; ``fields`` is an array of (field, left_value, right_value).
    Columns of the two dicts are compared by name.
    """
    fields = list(left_columns)
    if fields != list(right_columns):
        raise ValueError("both copies need the same fields, in the same order")
    a, b = _side(left, left_keys, left_columns, "l"), _side(right, right_keys, right_columns, "r")
    n = len(left_keys)
    on = [F.col(f"l_k{i}").eqNullSafe(F.col(f"r_k{i}")) for i in range(n)]
    joined = a.join(b, on, "full_outer")
    found = []
    for i, field in enumerate(fields):
        same_low, same_high = (F.col(f"l{i}_{end}").eqNullSafe(F.col(f"r{i}_{end}")) for end in ("low", "high"))
        one = F.col(f"l{i}_low").eqNullSafe(F.col(f"l{i}_high"))  # with both ends the same, the one value of either side
        same = same_low & same_high & one & F.col(f"l{i}_null").eqNullSafe(F.col(f"r{i}_null")) & ~(F.col(f"l{i}_null") & F.col(f"l{i}_low").isNotNull())
        left_shown = F.when(same_low & ~same_high, F.col(f"l{i}_high")).otherwise(F.col(f"l{i}_low"))
        shown = F.struct(F.lit(field).alias("field"), left_shown.alias("left_value"), F.when(same_low, F.col(f"r{i}_high")).otherwise(F.col(f"r{i}_low")).alias("right_value"))
        found.append(F.when(~same, shown))
    only_left, only_right = F.col("r_there").isNull(), F.col("l_there").isNull()
    side = F.when(only_left, "left").when(only_right, "right").otherwise("both")
    none = F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")
    differing = F.filter(F.array(*found), lambda x: x.isNotNull()) if fields else none
    keys = [F.when(only_right, F.col(f"r_k{i}")).otherwise(F.col(f"l_k{i}")).alias(f"key_{i}") for i in range(n)]
    rows = joined.select(*keys, side.alias("side"), F.when(side == "both", differing).otherwise(none).alias("fields"))
    return rows.filter((F.col("side") != "both") | (F.size("fields") > 0))


def iso_millis(text: Column) -> Column:
    """An ISO 8601 instant as milliseconds, rounded down, written as a string; anything else stays as it is written."""
    micros = F.unix_micros(F.try_to_timestamp(F.trim(text)))
    return F.coalesce(F.floor(micros / 1000).cast("long").cast("string"), text)


def archive_differences(facts: DataFrame, nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """(record_key, fact_index, difference): archive against store, and reports against the store."""
    held = nodes.filter(F.col("document_id").isNotNull())
    key = [F.col("document_id"), F.col("fact_index").cast("long")]
    rows = differences(
        facts,
        held,
        key,
        key,
        {"text": F.col("text"), "fact_type": F.col("fact_type"), "mentioned_at": iso_millis(F.col("mentioned_at"))},
        {"text": F.col("text"), "fact_type": F.col("fact_type"), "mentioned_at": F.col("mentioned_at").cast("long")},
    )
    label = F.when(F.col("side") == "left", F.array(F.lit("missing_in_store"))).when(F.col("side") == "right", F.array(F.lit("missing_in_archive"))).otherwise(F.col("fields.field"))
    of_facts = rows.select(F.col("key_0").alias("record_key"), F.col("key_1").alias("fact_index"), F.explode(label).alias("difference"))
    stored = held.filter(F.col("archive_id").isNotNull()).select("archive_id", "document_id", "fact_index").distinct().groupBy("archive_id").agg(F.count(F.lit(1)).alias("held"))
    checked = reports.select("archive_id", "facts").distinct().join(stored, "archive_id", "left")
    wrong = checked.filter(~F.col("facts").eqNullSafe(F.coalesce("held", F.lit(0)))).select(F.col("archive_id").alias("record_key"), F.lit(-1).cast("long").alias("fact_index"), F.lit("facts").alias("difference")).distinct()
    return of_facts.unionByName(wrong)
