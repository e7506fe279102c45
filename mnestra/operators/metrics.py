"""Histograms, quantiles, retrieval quality, savings and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnestra.operators.retrieval import top

#: Upper bounds of the latency buckets in microseconds; a last bucket takes the rest.
BOUNDS = (100, 500, 1_000, 2_000, 5_000, 10_000, 15_000, 20_000, 25_000, 30_000, 35_000, 40_000, 45_000, 50_000, 55_000, 60_000, 100_000, 250_000, 500_000)


def bucket(value: Column, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """Number of the first bound that is not below the value; the number of bounds, if there is none."""
    out = None
    for i, b in enumerate(bounds):
        out = F.when(value <= b, i) if out is None else out.when(value <= b, i)
    return F.when(value.isNotNull(), out.otherwise(len(bounds)))


def histogram(samples: DataFrame, by: list[str], value: str, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(by, bucket, n, total, most): counts of every bucket that has values."""
    rows = samples.filter(F.col(value).isNotNull())
    return rows.groupBy(*by, bucket(F.col(value), bounds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def histogram_quantiles(counts: DataFrame, by: list[str], bounds: tuple[int, ...] = BOUNDS, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Quantiles interpolated inside the bucket that holds the ceil(q n)-th value, never above the largest value.

    The last bucket has no upper bound, so a quantile in it is the largest value.
    """
    run = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    edges = F.array(*[F.lit(float(b)) for b in (0, *bounds)])
    rows = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(whole), "top": F.max("most").over(whole)})
    rows = rows.withColumns({"low": F.element_at(edges, F.col("bucket") + 1), "high": F.when(F.col("bucket") < len(bounds), F.element_at(edges, F.least(F.col("bucket") + 2, F.lit(len(bounds) + 1)))).otherwise(float("inf"))})
    out = []
    for q in quantiles:
        target = F.least(F.greatest(F.ceil(F.col("all") * F.lit(q)), F.lit(1)), F.col("all"))
        before = F.col("upto") - F.col("n")
        at = F.least(F.col("low") + (F.col("high") - F.col("low")) * (target - before) / F.col("n"), F.col("top").cast("double"))
        out.append(F.round(F.max(F.when((before < target) & (target <= F.col("upto")), at)), 6).alias(f"p{round(q * 100)}"))
    return rows.groupBy(*by).agg(F.first("all").alias("n"), F.sum("total").alias("total"), F.first("top").alias("most"), *out)


def under_limits(samples: DataFrame, by: list[str], value: str, limits: tuple[int, ...] = (35_000, 60_000)) -> DataFrame:
    """How many values are at most a limit; limits are bounds of buckets, which belong to the bucket below."""
    return samples.groupBy(*by).agg(*[F.count_if(F.col(value) <= limit).alias(f"under_{limit}") for limit in limits])


def saving(raw: Column, capped: Column) -> Column:
    """Share saved; null when either size is 0."""
    return F.when((raw > 0) & (capped > 0), 1 - capped / raw)


def tokens_saved(raw: Column, capped: Column) -> Column:
    return F.greatest(raw - capped, F.lit(0))


def saving_of_message(raw: Column, capped: Column) -> Column:
    """The share that capping saves of one message; 0 of an empty one, or if the capped form is larger."""
    return F.when(raw > 0, F.greatest(F.lit(0.0), 1 - capped / raw)).otherwise(0.0)


def sample_percentile(samples: DataFrame, by: list[str], value: str, percentiles: dict[str, float]) -> DataFrame:
    """The value at rank round((n - 1) p) of the sorted values, from counts of distinct values."""
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*by))})
    at = lambda p: F.floor((F.col("all") - 1) * F.lit(p) + 0.5)
    return rows.groupBy(*by).agg(F.first("all").alias("n"), *[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(name) for name, p in percentiles.items()])


def paired_deltas(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Differences a - b of the samples of the same round."""
    return a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key).select(*key, (F.col("_a") - F.col("_b")).alias("delta"))


def ranking_metrics(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of rankings by query: recall at 1, 5 and 10, reciprocal rank, nDCG at 10 and the recall that is possible.

    ``results(qid, node_id, rank)``, ``labels(qid, node_id, grade)``; grades of 0
    are not relevant, and queries without a relevant label are left out.
    """
    relevant = labels.filter("grade > 0").select("qid", "node_id", "grade").distinct()
    gain = lambda g, rank: (F.pow(F.lit(2.0), g) - 1) / F.log2(rank + 1)
    ideal = top(relevant, ["qid"], [F.desc("grade"), F.col("node_id")], None, "place")
    ideal = ideal.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= 10, gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("best"))
    hits = relevant.join(results.filter("rank <= 10").select("qid", "node_id", "rank"), ["qid", "node_id"])
    got = hits.groupBy("qid").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 5, 10)], F.min("rank").alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    n = F.col("relevant")
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / n, 6)
    return ideal.join(got, "qid", "left").select(
        "qid",
        share("h1").alias("recall_1"),
        share("h5").alias("recall_5"),
        share("h10").alias("recall_10"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)), 6).alias("ndcg_10"),
        F.round(F.least(F.lit(10), n) / n, 6).alias("ceiling"),
    )


def macro_average(per_query: DataFrame, strata: DataFrame) -> DataFrame:
    """Means over queries, by stratum and over all (stratum ``all``); every query counts once.

    ``excluded`` counts the queries of a stratum that have no figures, as none of their labels is relevant.
    """
    names = [c for c in per_query.columns if c != "qid"]
    rows = strata.select("qid", "stratum").join(per_query.withColumn("_there", F.lit(True)), "qid", "left")
    means = [F.round(F.avg(c), 6).alias(c) for c in names]
    grouped = rows.rollup("stratum").agg(F.count("_there").alias("queries"), F.count_if(F.col("_there").isNull()).alias("excluded"), *means, F.grouping("stratum").alias("every"))
    return grouped.select(F.when(F.col("every") == 1, "all").otherwise(F.col("stratum")).alias("stratum"), "queries", "excluded", *names)


def newest(rows: DataFrame, by: list[str], key: str, limit: int = 20) -> DataFrame:
    """The newest rows of an append-only ledger; the limit is held between 1 and 1,000."""
    return top(rows, by, [F.desc(key)], min(max(limit, 1), 1000), "nth")


def trend(snapshots: DataFrame, by: list[str], at: str, payload: str, path: str) -> DataFrame:
    """A number of JSON snapshots over time, scaled between its least and greatest value."""
    rows = snapshots.select(*by, at, F.get_json_object(payload, path).cast("double").alias("value")).filter("value is not null")
    per = Window.partitionBy(*by)
    low, high = F.min("value").over(per), F.max("value").over(per)
    return rows.withColumn("scaled", F.round(F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.5), 6))
