"""Entity resolution: which stored entity a mentioned name means."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mnestra.functions.timex import DAY_MS
from mnestra.operators.retrieval import top

NAME_FLOOR = 0.5
ACCEPT = 0.6
#: Full-width digits and the plain ones.
WIDE, NARROW = "０１２３４５６７８９", "0123456789"


def normalise_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def digit_runs(name: Column) -> Column:
    return F.regexp_extract_all(F.translate(name, WIDE, NARROW), F.lit(r"\d+"), F.lit(0))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two names, over Arrow batches."""
    matcher, out, held = difflib.SequenceMatcher(None), [], None
    for x, y in zip(a, b):
        if y != held:
            matcher.set_seq2(y)
            held = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def ratio_from_floor(a: pd.Series, b: pd.Series) -> pd.Series:
    """``name_ratio`` where the characters both names hold allow ``NAME_FLOOR``, else null."""
    matcher, out, held = difflib.SequenceMatcher(None), [], None
    for x, y in zip(a, b):
        if y != held:
            matcher.set_seq2(y)
            held = y
        matcher.set_seq1(x)
        out.append(matcher.ratio() if matcher.quick_ratio() >= NAME_FLOOR else None)
    return pd.Series(out, dtype="float64")


def could_reach(a: Column, b: Column, floor: float = NAME_FLOOR) -> Column:
    """Whether lengths alone allow the ratio; it is at most 2 min / (min + max)."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= F.lit(floor) * (F.length(a) + F.length(b))


def resolution_score(ratio: Column, overlap: Column, nearby: Column, days: Column) -> Column:
    recent = F.when(days < 7, F.greatest(F.lit(0.0), 1 - days / 7.0)).otherwise(0.0)
    shared = F.when(nearby > 0, overlap / nearby).otherwise(0.0)
    return 0.5 * ratio + 0.3 * shared + 0.2 * F.coalesce(recent, F.lit(0.0))


def resolve(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity of every mentioned name, or null for a new one.

    ``mentions(mention_id, bank_id, name, nearby array<string>, at)``,
    ``entities(id, bank_id, canonical_name, cooccurring, last_seen)`` ->
    (mention_id, entity_id, how, score).  An equal normalised name wins at once.
    Otherwise every candidate of the bank is compared whose digits agree and whose
    length allows the ratio, which must reach 0.5; the score must exceed 0.6.  Of equal scores the
    entity seen last comes first, then the least id.
    """
    known = entities.select(F.col("id").alias("entity_id"), "bank_id", normalise_name(F.col("canonical_name")).alias("known"), F.transform(F.coalesce("cooccurring", F.array().cast("array<string>")), normalise_name).alias("partners"), "last_seen")
    asked = mentions.select("mention_id", "bank_id", normalise_name(F.col("name")).alias("name"), F.array_distinct(F.transform(F.coalesce("nearby", F.array().cast("array<string>")), normalise_name)).alias("nearby"), "at").filter("name <> ''")
    same = asked.join(known.withColumnRenamed("known", "name"), ["bank_id", "name"])
    exact = top(same, ["mention_id"], [F.desc_nulls_last("last_seen"), F.col("entity_id")], 1, "_n").select("mention_id", "entity_id", F.lit("exact").alias("how"), F.lit(1.0).alias("score"))
    open_ = asked.join(exact, "mention_id", "left_anti")
    names = open_.select("bank_id", "name").distinct()  # every distinct name is compared once
    digits = lambda c: F.array_join(digit_runs(F.col(c)), ",").alias("digits")
    met = names.select("bank_id", "name", digits("name")).join(known.select("bank_id", "known", digits("known")).distinct(), ["bank_id", "digits"]).filter(could_reach(F.col("name"), F.col("known")))
    alike = met.select("bank_id", "name", "known", ratio_from_floor("known", "name").alias("ratio")).filter(F.col("ratio") >= NAME_FLOOR)
    pairs = open_.join(alike, ["bank_id", "name"]).join(known, ["bank_id", "known"])
    overlap = F.size(F.array_intersect("nearby", "partners"))
    days = F.abs(F.col("at") - F.col("last_seen")) / float(DAY_MS)
    scored = pairs.withColumn("score", F.round(resolution_score(F.col("ratio"), overlap, F.size("nearby"), days), 9)).filter(F.col("score") > ACCEPT)
    fuzzy = top(scored, ["mention_id"], [F.desc("score"), F.desc_nulls_last("last_seen"), F.col("entity_id")], 1, "_n").select("mention_id", "entity_id", F.lit("similar").alias("how"), "score")
    found = exact.unionByName(fuzzy)
    return asked.select("mention_id").join(found, "mention_id", "left").select("mention_id", "entity_id", F.coalesce("how", F.lit("new")).alias("how"), "score")
