"""Derived tables that several queries read, in Spark and as SQL; and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.operators.entities import normalise_name
from mnestra.operators.retrieval import Store, TextIndex, text_index
from mnestra.session import table

NOW_MS = 1_782_864_000_000  # 2026-07-01T00:00:00Z, after the last row of the test tables
DAY_MS = 86_400_000


class Registry:
    """Queries of a module, each with its SQL if SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = lambda spark, sf_dir: _wide(f(lambda t: table(spark, sf_dir, t)))
            if sql:
                self.oracle[name] = sql
            return f

        return keep


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as SQL counts them."""
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int"})


Tables = Callable[[str], DataFrame]


def entities(t: Tables) -> DataFrame:
    """One row a bank and normalised name."""
    named = t("entities").select("id", "bank_id", normalise_name(F.col("canonical_name")).alias("name"), "mention_count", "last_seen").filter("name <> ''")
    return named.groupBy("bank_id", "name").agg(F.min("id").alias("id"), F.max("mention_count").alias("mention_count"), F.max("last_seen").alias("last_seen"))


def fact_names(t: Tables) -> DataFrame:
    listed = t("archive_facts").select("bank_id", "document_id", "fact_index", F.explode("entities").alias("e"))
    return listed.select("bank_id", "document_id", "fact_index", normalise_name(F.col("e")).alias("name")).filter("name <> ''").distinct()


def node_entities(t: Tables) -> DataFrame:
    nodes = t("memory_nodes").select(F.col("id").alias("node_id"), "bank_id", "document_id", "fact_index", F.col("created_at").alias("at"))
    known = entities(t).select("bank_id", "name", F.col("id").alias("entity_id"))
    return fact_names(t).join(known, ["bank_id", "name"]).join(nodes, ["bank_id", "document_id", "fact_index"]).select("node_id", "entity_id", "at").distinct()


def node_tags(t: Tables) -> DataFrame:
    tags = t("archive_facts").select("document_id", "fact_index", F.explode("tags").alias("tag")).filter("tag is not null").distinct()
    return tags.join(t("memory_nodes").select(F.col("id").alias("node_id"), "document_id", "fact_index"), ["document_id", "fact_index"]).select("node_id", "tag").distinct()


def sources(t: Tables) -> DataFrame:
    """Observations and the facts that they are linked to."""
    kinds = t("memory_nodes").select("id", "fact_type")
    a = kinds.filter("fact_type = 'observation'").select(F.col("id").alias("from_node_id"))
    b = kinds.filter("fact_type <> 'observation'").select(F.col("id").alias("to_node_id"))
    linked = t("links").select("from_node_id", "to_node_id").join(a, "from_node_id").join(b, "to_node_id")
    return linked.select(F.col("from_node_id").alias("observation_id"), F.col("to_node_id").alias("source_id")).distinct()


def vectors(t: Tables) -> DataFrame:
    """Usable vectors, one a node."""
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return t("node_vectors").filter(F.col("embedding").isNotNull() & fine).dropDuplicates(["node_id"]).select("node_id", "bank_id", "embedding", "embedding_model")


def asked(t: Tables) -> DataFrame:
    """Queries: every node whose id is divisible by 20, with its text, vector and the week from its day on."""
    day = F.floor(F.coalesce("occurred_start", "mentioned_at") / DAY_MS) * DAY_MS
    nodes = t("memory_nodes").filter("id % 20 = 0").select(F.col("id").alias("qid"), "bank_id", "text", day.alias("first_ms"), (day + 7 * DAY_MS - 1).alias("last_ms"))
    return nodes.join(vectors(t).select(F.col("node_id").alias("qid"), F.col("embedding").alias("vector")), "qid", "left")


def index(t: Tables) -> TextIndex:
    return text_index(t("memory_nodes"), keep="nodes")


def store(t: Tables) -> Store:
    return Store(t("memory_nodes"), vectors(t), t("links"), entities(t), node_entities(t).select("node_id", "entity_id"), node_tags(t), sources(t), index(t))


# The same tables as common table expressions.
_TRIM = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
ENT = f"ent AS (SELECT bank_id, {_TRIM.format('canonical_name')} AS name, min(id) AS id, max(mention_count) AS mention_count, max(last_seen) AS last_seen FROM entities WHERE {_TRIM.format('canonical_name')} <> '' GROUP BY ALL)"
NAMES = f"named AS (SELECT DISTINCT bank_id, document_id, fact_index, {_TRIM.format('e')} AS name FROM (SELECT bank_id, document_id, fact_index, unnest(entities) AS e FROM archive_facts) WHERE {_TRIM.format('e')} <> '')"
MEMBERS = f"{ENT}, {NAMES}, members AS (SELECT DISTINCT n.id AS node_id, e.id AS entity_id, n.created_at AS seen_at FROM named f JOIN ent e ON e.bank_id = f.bank_id AND e.name = f.name JOIN memory_nodes n ON n.bank_id = f.bank_id AND n.document_id = f.document_id AND n.fact_index = f.fact_index)"
TAGS = "tagged AS (SELECT DISTINCT n.id AS node_id, f.tag FROM (SELECT DISTINCT document_id, fact_index, unnest(tags) AS tag FROM archive_facts) f JOIN memory_nodes n ON n.document_id = f.document_id AND n.fact_index = f.fact_index WHERE f.tag IS NOT NULL)"
SOURCES = "sources AS (SELECT DISTINCT l.from_node_id AS observation_id, l.to_node_id AS source_id FROM links l JOIN memory_nodes o ON o.id = l.from_node_id AND o.fact_type = 'observation' JOIN memory_nodes s ON s.id = l.to_node_id AND s.fact_type <> 'observation')"
VECTORS = "vecs AS (SELECT node_id, any_value(bank_id) AS bank_id, any_value(embedding)::DOUBLE[] AS v, any_value(embedding_model) AS embedding_model FROM node_vectors WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY node_id)"
ASKED = f"asked AS (SELECT id AS qid, bank_id, text, coalesce(occurred_start, mentioned_at) // {DAY_MS} * {DAY_MS} AS first_ms, coalesce(occurred_start, mentioned_at) // {DAY_MS} * {DAY_MS} + {7 * DAY_MS - 1} AS last_ms FROM memory_nodes WHERE id % 20 = 0)"
