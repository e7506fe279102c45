"""Problem 7: mixing sources to target weights.

Method: iterative proportional fitting.  Tokens are summed by cell (source,
language, topic).  Cell weights, that is, how often a text of the cell is to be
taken, are raked to the target share of every source and to the share that every
language and topic has in the sources used, none above the repeats its source
allows, with the sources last, so that their shares hold exactly.  A weight of
2.3 takes every text of the cell twice and a calibrated 30 % of its tokens a
third time, chosen by hash: cells are cut at a hash threshold from a histogram
of 1,024 parts, and the part at the threshold is cut again.

The mix is the largest in which all sources keep their shares (or
``total_tokens``, if that is less).  A source without tokens cannot get a share;
the others then keep their proportions.

Every language and topic is a marginal of its own, null among them.  Where there are
more than ``NAMES`` of either, the ``NAMES`` with the most tokens are, and the others fall into
``NAMES`` hash buckets, so that the table of cells that is fitted on the driver and sent to the
tasks has a fixed bound: at most (sources in the targets) x 128 x 128.

Defined results: sources compare after trim and lower case; texts whose source
is null or not in the targets, and null or empty texts, are not taken; a null
``max_repeats`` means once; repeated rows are texts of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnestra.llm.tokens import VOCABULARY, with_copies, with_token_counts
from mnestra.session import materialise

NAMES = 64
PARTS = 1024


def clean_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def water_fill(weight: np.ndarray, tokens: np.ndarray, cap: np.ndarray, target: float) -> np.ndarray:
    """Scale weights so that the tokens taken meet the target, none above its cap."""
    weight = np.maximum(weight, 1e-12)
    if (cap * tokens).sum() <= target:
        return cap.copy()
    free = np.ones(len(weight), bool)
    out = cap.copy()
    for _ in range(len(weight) + 1):
        scale = (target - (cap * tokens)[~free].sum()) / max((weight * tokens)[free].sum(), 1e-300)
        over = free & (weight * scale > cap)
        out = np.where(free, weight * scale, cap)
        if not over.any():
            break
        free &= ~over
    return np.minimum(out, cap)


def rake(cells: list[dict], shares: dict[str, float], caps: dict[str, int], total_tokens: float | None = None, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights of cells (dicts with source, lang, topic, tokens) and the size of the mix."""
    if not cells:
        return np.zeros(0), 0.0
    tokens = np.array([c["tokens"] for c in cells], float)
    cap = np.array([caps[c["source"]] for c in cells], float)
    by = {k: np.unique([c[k] for c in cells], return_inverse=True) for k in ("source", "lang", "topic")}
    names, source = by["source"]
    share = np.array([shares[s] for s in names])
    share = share / share.sum()
    there = np.bincount(source, tokens, len(names))
    limit = np.array([caps[s] for s in names]) * there
    size = min([b / p for b, p in zip(limit, share) if p > 0], default=0.0)
    size = min(size, total_tokens) if total_tokens is not None else size
    weight = (share * size / there)[source]
    for _ in range(rounds):
        before = weight.copy()
        for k in ("lang", "topic"):
            _, of = by[k]
            want = np.bincount(of, tokens) / tokens.sum() * size
            have = np.bincount(of, weight * tokens)
            weight = np.minimum(weight * (want / np.maximum(have, 1e-300))[of], cap)
        for s in range(len(names)):
            mine = np.flatnonzero(source == s)
            weight[mine] = water_fill(weight[mine], tokens[mine], cap[mine], share[s] * size)
        if np.abs(weight - before).max() < 1e-9:
            break
    return weight, size


def _numbered(rows: DataFrame, name: str) -> Column:
    """The number of the marginal that a language or topic belongs to."""
    most = rows.groupBy(name).agg(F.sum("tokens").alias("n")).filter(F.col(name).isNotNull()).orderBy(F.desc("n"), name).limit(NAMES + 1).collect()
    known = [r[name] for r in most[:NAMES]]
    own = F.create_map(*[F.lit(x) for i, k in enumerate(known) for x in (k, i + 1)])[F.col(name)] if known else F.lit(None).cast("int")
    other = NAMES + 1 + F.pmod(F.xxhash64(name), F.lit(NAMES)).cast("int")
    return F.when(F.col(name).isNull(), 0).otherwise(F.coalesce(own, other)).cast("int").alias(name)


def _counted(documents: DataFrame, targets: dict[str, tuple[float, int]], vocabulary: str) -> DataFrame:
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        clean_source(F.col("source")).alias("source"),
        F.lower(F.trim("lang")).alias("lang"),
        F.substring_index("bank_id", "::", 1).alias("topic"),
        "text",
    ).filter(F.col("source").isin(list(targets)) & (F.length("text") > 0))
    counted = materialise(with_token_counts(rows, vocabulary=vocabulary), "tokens").filter("tokens > 0")
    rows = with_copies(counted, "row")
    return rows.select("row", "doc_id", "source", "tokens", _numbered(counted, "lang"), _numbered(counted, "topic"))


def clean_targets(rows: list[tuple]) -> dict[str, tuple[float, int]]:
    """{source: (share, most repeats)} of mix_targets rows (source, target_share, max_repeats)."""
    out: dict[str, tuple[float, int]] = {}
    for source, share, repeats in rows:
        if source is None or share is None or share <= 0:
            continue
        name = source.strip().lower()
        had = out.get(name, (0.0, 0))
        out[name] = (had[0] + float(share), max(had[1], 1 if repeats is None else int(repeats)))
    return {s: (share, repeats) for s, (share, repeats) in out.items() if repeats > 0}


def mix_sources(documents: DataFrame, targets: list[tuple], total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents(doc_id, text, source, lang, bank_id)`` -> (doc_id, source, tokens, copies) of the texts taken."""
    spark = documents.sparkSession
    wanted = clean_targets(targets)
    empty = spark.createDataFrame([], "doc_id long, source string, tokens int, copies int")
    if not wanted:
        return empty
    rows = _counted(documents, wanted, vocabulary).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "row"), F.lit(PARTS)).cast("int"))
    cell = ["source", "lang", "topic"]
    histogram = materialise(rows.groupBy(*cell, "part").agg(F.sum("tokens").cast("long").alias("tokens")), "histogram")
    cells = [r.asDict() for r in histogram.groupBy(*cell).agg(F.sum("tokens").alias("tokens")).orderBy(*cell).collect()]
    if not cells:
        return empty
    weight, _ = rake(cells, {s: w[0] for s, w in wanted.items()}, {s: w[1] for s, w in wanted.items()}, total_tokens)
    fitted = spark.createDataFrame([(c["source"], c["lang"], c["topic"], float(w), float(c["tokens"])) for c, w in zip(cells, weight)], "source string, lang int, topic int, weight double, all_tokens double")
    base = F.floor(F.col("weight") + 1e-9)
    fitted = fitted.select(*cell, base.cast("int").alias("base"), (F.greatest(F.col("weight") - base, F.lit(0.0)) * F.col("all_tokens")).alias("more"))
    part = F.struct("part", "tokens")
    # at most 1,024 parts a cell, so this list is bounded
    cut = histogram.groupBy(*cell).agg(F.array_sort(F.collect_list(part)).alias("parts")).join(F.broadcast(fitted), cell)
    cut = cut.select(
        *cell,
        "base",
        F.expr(
            "aggregate(parts, named_struct('left', more, 'part', -1, 'share', 0D), (a, p) -> named_struct("
            "'left', a.left - p.tokens, 'part', if(a.left >= p.tokens, p.part, a.part), 'share', if(a.left > 0 and a.left < p.tokens, a.left / p.tokens, a.share)), "
            "a -> named_struct('part', a.part, 'share', a.share))"
        ).alias("cut"),
        F.expr("transform(parts, p -> p.part)").alias("order"),
    )
    cut = cut.select(*cell, "base", F.col("cut.part").alias("whole"), F.expr("element_at(filter(order, p -> p > cut.part), 1)").alias("next"), F.col("cut.share").alias("share"))
    uniform = F.pmod(F.xxhash64(F.lit("within"), "row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    again = (F.col("part") <= F.col("whole")) | ((F.col("part") == F.col("next")) & (uniform < F.col("share")))
    return rows.join(F.broadcast(cut), cell).withColumn("copies", F.col("base") + F.when(again, 1).otherwise(0)).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def mix_report(mixed: DataFrame, targets: list[tuple]) -> DataFrame:
    """(source, target_share, max_repeats, texts, copies, tokens, reached_share, most_copies) of every target."""
    spark = mixed.sparkSession
    wanted = spark.createDataFrame([(s, share, repeats) for s, (share, repeats) in clean_targets(targets).items()], "source string, target_share double, max_repeats int")
    taken = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies"), F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = taken.agg(F.sum("tokens").alias("total"))
    joined = wanted.join(taken, "source", "left").fillna(0).join(F.broadcast(total))
    return joined.select("source", "target_share", "max_repeats", "texts", "copies", "tokens", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"), "most_copies")
