"""Queries of the general problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.operators.diff import archive_differences
from mnestra.operators.instants import inbound_instants, inbound_values
from mnestra.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_differences(table(spark, sf_dir, "archive_facts"), table(spark, sf_dir, "memory_nodes"), table(spark, sf_dir, "bank_reports"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound_instants(table(spark, sf_dir, "inbound_facts"))


def p4_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inbound_values(table(spark, sf_dir, "inbound_facts"))
    return found.select(F.col("id").alias("fact_id"), "field_name", "reading", "state", F.round("posterior", 6).alias("posterior"), "utc_ms")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_undeclared": p4_undeclared}

ORACLE = {
    "p3_found": """
WITH a AS (SELECT DISTINCT document_id, fact_index, text, fact_type, epoch_us(mentioned_at::TIMESTAMPTZ) // 1000 AS m FROM archive_facts),
     b AS (SELECT DISTINCT document_id, fact_index, text, fact_type, mentioned_at AS m FROM memory_nodes WHERE document_id IS NOT NULL),
     j AS (SELECT coalesce(a.document_id, b.document_id) AS record_key, coalesce(a.fact_index, b.fact_index) AS fact_index,
                  b.document_id IS NULL AS no_b, a.document_id IS NULL AS no_a,
                  a.text IS DISTINCT FROM b.text AS dt, a.fact_type IS DISTINCT FROM b.fact_type AS df, a.m IS DISTINCT FROM b.m AS dm
           FROM a FULL JOIN b ON a.document_id = b.document_id AND a.fact_index = b.fact_index),
     held AS (SELECT archive_id, count(*) AS n FROM (SELECT DISTINCT archive_id, document_id, fact_index FROM memory_nodes
              WHERE archive_id IS NOT NULL AND document_id IS NOT NULL) GROUP BY archive_id)
SELECT record_key, fact_index, 'missing_in_store' AS difference FROM j WHERE no_b
UNION SELECT record_key, fact_index, 'missing_in_archive' FROM j WHERE no_a
UNION SELECT record_key, fact_index, 'text' FROM j WHERE NOT no_a AND NOT no_b AND dt
UNION SELECT record_key, fact_index, 'fact_type' FROM j WHERE NOT no_a AND NOT no_b AND df
UNION SELECT record_key, fact_index, 'mentioned_at' FROM j WHERE NOT no_a AND NOT no_b AND dm
UNION SELECT r.archive_id, -1, 'facts' FROM bank_reports r LEFT JOIN held h ON r.archive_id = h.archive_id
      WHERE r.facts IS DISTINCT FROM coalesce(h.n, 0)
""",
}
