"""Integrity rules, samples and verdicts of a transfer between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnestra.operators.graph import temporal_links
from mnestra.operators.retrieval import top


def archive_violations(facts: DataFrame) -> DataFrame:
    """(rule, document_id, fact_index) of the facts of an archive that cannot be imported as they are."""
    keyed = facts.select("document_id", "fact_index", "text", "fact_type", "causal_relations", "mentioned_at", "occurred_start", "event_date")
    there = facts.select("document_id", F.col("fact_index").alias("target")).distinct()
    named = keyed.select("document_id", "fact_index", F.explode("causal_relations.target_fact_index").alias("target")).distinct()
    rules = [
        ("empty_text", keyed.filter(F.trim(F.coalesce("text", F.lit(""))) == "")),
        ("unknown_type", keyed.filter(~F.coalesce(F.col("fact_type").isin("world", "experience", "observation"), F.lit(False)))),
        ("no_date", keyed.filter("mentioned_at is null and occurred_start is null and event_date is null")),
        ("causes_itself", named.filter("target = fact_index")),
        ("cause_out_of_range", named.join(there, ["document_id", "target"], "left_anti")),
    ]
    out = None
    for name, rows in rules:
        part = rows.select(F.lit(name).alias("rule"), "document_id", "fact_index").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def in_band(ratio: Column, low: float = 1.45, high: float = 1.75) -> Column:
    return F.when(ratio.isNull(), "review").when(ratio.between(low, high), "pass").otherwise("fail")


def verdict(checks: DataFrame, by: list[str]) -> DataFrame:
    """fail before review before pass, of rows with ``state``."""
    worst = F.max(F.when(F.col("state") == "fail", 2).when(F.col("state") == "review", 1).otherwise(0))
    return checks.groupBy(*by).agg(F.element_at(F.array(F.lit("pass"), F.lit("review"), F.lit("fail")), worst + 1).alias("verdict"))


def stratified_sample(rows: DataFrame, by: str, key: str, want: int, seed: int = 0) -> DataFrame:
    """A seeded sample with a share for every stratum: round(want n / all), at least one row.

    Which rows are taken follows from hashes of seed and key, so the sample is the same every time.
    A stratum is not ranked whole: rows go on whose hash is below a threshold that some twice the share and
    forty more are expected to pass; a stratum in which too few do is ranked again without it.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    quota = sizes.join(F.broadcast(total)).select(by, F.greatest(F.lit(1), F.floor(F.lit(want) * F.col("_n") / F.col("_all") + 0.5)).alias("_quota"))
    quota = quota.join(sizes, by).withColumn("_upto", (2 * F.col("_quota") + 40) / F.col("_n"))
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))).join(quota, by)
    low = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / float(2**32) <= F.col("_upto")
    some = hashed.filter(low)
    short = some.groupBy(by).agg((F.count(F.lit(1)) < F.first("_quota")).alias("_short"))
    short = quota.select(by).join(short, by, "left").filter(F.coalesce("_short", F.lit(True))).select(by)
    chosen = some.unionByName(hashed.filter(~low).join(short, by, "left_semi"))
    return top(chosen, [by], [F.col("_hash"), F.col(key)], None, "_place").filter("_place <= _quota").select(*rows.columns)


def link_differences(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """(from_node_id, to_node_id, side): links only stored (extra) or only derived anew (missing)."""
    key = ["from_node_id", "to_node_id"]
    a, b = stored.select(*key).distinct(), derived.select(*key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def temporal_differences(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``link_differences`` of the stored temporal links and those derived anew, both ends being nodes of an archive."""
    held = nodes.filter("archive_id is not null")
    ends = held.select("id").distinct()
    stored = links.filter("link_type = 'temporal'").join(ends.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi").join(ends.withColumnRenamed("id", "to_node_id"), "to_node_id", "left_semi")
    return link_differences(stored, temporal_links(held))


def nth_copies(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Number repeated rows, so that the n-th copies of two sides can be joined."""
    return top(rows, by, [F.col(order)], None, "nth")


def out_degrees(links: DataFrame, link_type: str) -> DataFrame:
    """(from_node_id, degree) over the distinct links of a type."""
    return links.filter(F.col("link_type") == link_type).select("from_node_id", "to_node_id").distinct().groupBy("from_node_id").agg(F.count(F.lit(1)).alias("degree"))


def against_baseline(ledger: DataFrame, results: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Results beside the newest earlier row with the same key; ``same`` asks for equality of every bit."""
    last = ledger.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_n = 1").select(*key, F.col(value).alias("baseline"))
    return results.join(last, key, "left").withColumn("same", F.col(value).eqNullSafe(F.col("baseline")))
