"""The queries of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.llm.anisotropic import similar_vectors
from mnestra.llm.bagminhash import near_duplicate_groups, near_duplicate_pairs
from mnestra.llm.cooccurrence import cooccurrence
from mnestra.llm.mixing import mix_report, mix_sources
from mnestra.llm.packing import compare_with_best_fit, pack_texts
from mnestra.llm.spans import shared_passages, shared_spans
from mnestra.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "node_vectors"))


def p1_in_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p1_found`` with leaves for every bank of more than 64 vectors, so that they are tried on tables of any size."""
    return similar_vectors(table(spark, sf_dir, "node_vectors"), large=64, leaf_rows=32)


def _names_together(spark: SparkSession, sf_dir: str, min_together: int = 6, chunk: int = 64) -> DataFrame:
    facts = table(spark, sf_dir, "archive_facts")
    return cooccurrence(facts, "bank_id", ["document_id", "fact_index"], "entities", min_together=min_together, chunk=chunk)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exceeds = F.col("together") * F.col("baskets") >= 8 * F.col("baskets_1") * F.col("baskets_2")
    return _names_together(spark, sf_dir).filter(exceeds).select("bank_id", F.col("item_1").alias("name_1"), F.col("item_2").alias("name_2"))


def _scores(pairs: DataFrame) -> DataFrame:
    return pairs.select("bank_id", "item_1", "item_2", "together", "baskets_1", "baskets_2", "baskets", F.round("lift", 6).alias("lift"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_names_together(spark, sf_dir))


def p2_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_names_together(spark, sf_dir, min_together=1))


def p2_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p2_scores`` with every record of more than three names in chunks."""
    return _scores(_names_together(spark, sf_dir, chunk=3))


def _near_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "archive_facts").select(F.lit("text").alias("field_name"), F.col("row_id").alias("id"), F.col("text").alias("value"))
    refreshes = table(spark, sf_dir, "mental_refreshes").select(F.lit("content").alias("field_name"), F.col("refresh_id").alias("id"), F.col("content").alias("value"))
    return facts.unionByName(refreshes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(_near_records(spark, sf_dir), 0.7)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: its group at a similarity of 0.8, and how many links its set of words has."""
    return near_duplicate_groups(_near_records(spark, sf_dir), 0.8)


def _limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r["profile"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_limits").collect()]


def p6_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of best fit, of the genetic search, and the lower bound."""
    return compare_with_best_fit(table(spark, sf_dir, "documents"), _limits(spark, sf_dir))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), _limits(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return [tuple(r) for r in table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").collect()]


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), _targets(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return mix_report(mix_sources(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), 200)


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the shared passages stand in each document."""
    return shared_passages(table(spark, sf_dir, "documents"), 200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_in_leaves, p2_found, p2_scores, p2_all_scores, p2_in_chunks, p5_found, p5_groups, p6_pack, p6_compared, p7_mix, p7_shares, p8_found, p8_passages)
}

_PAIRS = r"""
WITH listed AS (SELECT DISTINCT bank_id, document_id, fact_index, lower(regexp_replace(n, '^\s+|\s+$', '', 'g')) AS name
                FROM (SELECT bank_id, document_id, fact_index, unnest(entities) AS n FROM archive_facts)
                WHERE n IS NOT NULL AND regexp_replace(n, '^\s+|\s+$', '', 'g') <> '' AND bank_id IS NOT NULL),
     total AS (SELECT bank_id, count(*) AS baskets FROM (SELECT DISTINCT bank_id, document_id, fact_index FROM archive_facts) GROUP BY bank_id),
     single AS (SELECT bank_id, name, count(*) AS n FROM listed GROUP BY bank_id, name),
     pairs AS (SELECT l.bank_id, l.name AS name_1, r.name AS name_2, count(*) AS together
               FROM listed l JOIN listed r ON l.bank_id = r.bank_id AND l.document_id IS NOT DISTINCT FROM r.document_id
                AND l.fact_index IS NOT DISTINCT FROM r.fact_index AND l.name < r.name GROUP BY ALL HAVING count(*) >= 6),
     scored AS (SELECT p.*, a.n AS n1, b.n AS n2, t.baskets FROM pairs p
                JOIN single a ON a.bank_id = p.bank_id AND a.name = p.name_1
                JOIN single b ON b.bank_id = p.bank_id AND b.name = p.name_2
                JOIN total t ON t.bank_id = p.bank_id)
"""
_SCORES = "SELECT bank_id, name_1 AS item_1, name_2 AS item_2, together, n1 AS baskets_1, n2 AS baskets_2, baskets, round(together * baskets / (n1::DOUBLE * n2), 6) AS lift FROM scored"
ORACLE: dict[str, str] = {
    "p2_all_scores": _PAIRS.replace(" HAVING count(*) >= 6", "") + _SCORES,
    "p2_found": _PAIRS + "SELECT bank_id, name_1, name_2 FROM scored WHERE together * baskets >= 8 * n1 * n2",
    "p2_in_chunks": _PAIRS + _SCORES,
    "p2_scores": _PAIRS
    + _SCORES,
}
