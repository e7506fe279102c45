"""Banks and their tables: statistics, patches, deletion, paging, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnestra.operators.retrieval import top

TYPES = ("world", "experience", "observation")


def bank_stats(banks: DataFrame, nodes: DataFrame, documents: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row a bank, also for banks that hold nothing: nodes by type, backlog, documents, links."""
    counted = nodes.groupBy("bank_id").agg(F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("fact_type") == t).alias(t) for t in TYPES])
    embedded = vectors.filter("embedding is not null").select("node_id").distinct()
    backlog = nodes.join(embedded, F.col("id") == F.col("node_id"), "left_anti").groupBy("bank_id").agg(F.count(F.lit(1)).alias("unembedded"))
    texts = documents.groupBy("bank_id").agg(F.count(F.lit(1)).alias("documents"))
    unique = links.select("from_node_id", "to_node_id", "link_type", "entity_id").distinct()
    linked = unique.join(nodes.select(F.col("id").alias("from_node_id"), "bank_id"), "from_node_id").groupBy("bank_id").agg(F.count(F.lit(1)).alias("links"))
    out = banks.select("bank_id")
    for part in (counted, backlog, texts, linked):
        out = out.join(part, "bank_id", "left")
    return out.fillna(0)


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where a change gives one; null means untouched, and ``clear`` lists columns set to null."""
    given = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.coalesce("clear", F.array().cast("array<string>")).alias("_clear"))
    joined = base.join(given, key, "left")
    new = {c: F.when(F.array_contains("_clear", c), F.lit(None)).otherwise(F.coalesce(f"_{c}", c)) for c in columns}
    return joined.withColumns(new).select(*base.columns)


def delete_banks(tables: dict[str, DataFrame], gone: DataFrame, keep_rows: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All tables without the rows of deleted banks; tables in ``keep_rows`` keep them with a null bank."""
    gone = gone.select("bank_id").distinct()
    marked = gone.withColumn("_gone", F.lit(True))
    out = {}
    for name, df in tables.items():
        if name in keep_rows:
            out[name] = df.join(marked, "bank_id", "left").withColumn("bank_id", F.when(F.col("_gone").isNull(), F.col("bank_id"))).select(*df.columns)
        else:
            out[name] = df.join(gone, "bank_id", "left_anti").select(*df.columns)
    return out


def delete_cascade(gone: DataFrame, banks: DataFrame, nodes: DataFrame, documents: DataFrame, links: DataFrame, by_bank: dict[str, DataFrame], by_node: dict[str, DataFrame], ledgers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table after banks are deleted.

    Nodes, documents and the tables ``by_bank`` go with their bank; links go with either end and the tables
    ``by_node(node_id)`` with their node; nodes of other banks lose a document that is gone; ledgers keep
    their rows with a null bank.
    """
    first = delete_banks({"banks": banks, "memory_nodes": nodes, "documents": documents, **by_bank, **ledgers}, gone, tuple(ledgers))
    dead = nodes.join(gone.select("bank_id").distinct(), "bank_id", "left_semi").select("id")
    left = {c: dead.select(F.col("id").alias(c)) for c in ("from_node_id", "to_node_id", "node_id")}
    out = dict(first)
    out["links"] = links.join(left["from_node_id"], "from_node_id", "left_anti").join(left["to_node_id"], "to_node_id", "left_anti").select(*links.columns)
    for name, df in by_node.items():
        out[name] = df.join(left["node_id"], "node_id", "left_anti").select(*df.columns)
    lost = documents.join(gone.select("bank_id").distinct(), "bank_id", "left_semi").select(F.col("doc_key").alias("_lost")).distinct()
    kept = first["memory_nodes"].join(lost, F.col("document_id") == F.col("_lost"), "left")
    out["memory_nodes"] = kept.withColumn("document_id", F.when(F.col("_lost").isNull(), F.col("document_id"))).select(*nodes.columns)
    return out


def after_id(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """A page by key: the next rows above ``after``."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(limit)


def backlog(nodes: DataFrame, vectors: DataFrame, limit: int | None = 8) -> DataFrame:
    """The next nodes of every bank to embed: those without a vector, by id."""
    have = vectors.filter("embedding is not null").select(F.col("node_id").alias("id")).distinct()
    return top(nodes.join(have, "id", "left_anti"), ["bank_id"], [F.col("id")], limit, "nth")


def health(database_ok: Column, embed_error: Column, model_reachable: Column) -> Column:
    return F.when(~database_ok, "UNHEALTHY").when(embed_error | ~model_reachable, "DEGRADED").otherwise("HEALTHY")


def merge_metadata(metadata: Column, values: dict[str, Column]) -> Column:
    """JSON metadata with some keys set."""
    given = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    held = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: ~k.isin(*values)), given))


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def table_counts(nodes: DataFrame) -> DataFrame:
    """Banks and nodes in all."""
    return nodes.agg(F.countDistinct("bank_id").alias("banks"), F.count(F.lit(1)).alias("nodes"))


def duplicates(documents: DataFrame, by: str = "bank_id") -> DataFrame:
    """(by, content_hash, n, first_doc_id): texts that stand in more than one document."""
    hashed = documents.filter("text is not null").select(by, "doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy(by, "content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id")).filter("n > 1")
