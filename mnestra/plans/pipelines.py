"""Jobs composed of operators: importing an archive, a consolidation round, a backlog tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.functions import text as T
from mnestra.functions.timex import iso_ms
from mnestra.operators import curation as C
from mnestra.operators import graph as G
from mnestra.operators import retrieval as R
from mnestra.operators import verify as V
from mnestra.operators.archive import Archive, importable
from mnestra.operators.retrieval import top
from mnestra.plans import tables as D
from mnestra.plans.tables import Registry, Tables
from mnestra.session import materialise
from mnestra.sources.files import insert_nodes

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def import_archive(facts: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """Nodes, causal and temporal links and a watermark a bank, made from the facts of an archive.

    A fact exported twice comes in once (its least row_id); one that breaks a
    rule that forbids storing it (no text, unknown type, no date) stays out.
    """
    broken = V.archive_violations(facts).filter(F.col("rule").isin("empty_text", "unknown_type", "no_date")).select("document_id", "fact_index").distinct()
    first = top(facts, ["document_id", "fact_index"], [F.col("row_id")], 1, "_n").drop("_n").join(broken, ["document_id", "fact_index"], "left_anti")
    times = {c: iso_ms(F.col(c)).cast("long") for c in ("occurred_start", "occurred_end", "mentioned_at")}
    nodes = first.select("bank_id", "archive_id", "document_id", "fact_index", "fact_type", "text", "context", "causal_relations", *[v.alias(k) for k, v in times.items()])
    nodes = nodes.withColumn("event_date", F.coalesce("occurred_start", "mentioned_at"))
    nodes = materialise(insert_nodes(nodes, stored.select("id"), ["document_id", "fact_index"]), "imported")
    marks = nodes.groupBy("bank_id").agg(F.max("id").alias("watermark"))
    return {"nodes": nodes.drop("causal_relations"), "causal": G.causal_links(nodes, nodes), "temporal": G.temporal_links(nodes), "watermarks": marks}


def import_whole(found: Archive, stored: DataFrame) -> dict[str, DataFrame]:
    """All that an import writes: documents, nodes of facts and observations, provenance, causal and temporal links, watermarks.

    Archives with a violation of ``archive.importable`` that touches them as a whole stay out, as do single facts and observations with one of their own.
    """
    wrong = materialise(importable(found), "violations")
    barred = wrong.filter("document_id is null").select("archive").distinct()
    named = found.manifests.join(barred, "archive", "left_anti").select("archive", F.col("source_bank_id").alias("bank_id"))
    bad = wrong.filter(F.col("place").isNotNull() & (F.col("rule") != "cause_out_of_range")).select("archive", "document_id", F.col("place").alias("nth")).distinct()
    times = lambda: [iso_ms(F.col(c)).cast("long").alias(c) for c in ("occurred_start", "occurred_end", "mentioned_at")]
    facts = found.facts.withColumn("nth", F.col("fact_index")).join(bad, ["archive", "document_id", "nth"], "left_anti").join(named, "archive")
    facts = facts.select("archive", "bank_id", "document_id", "fact_index", "fact_type", "text", "context", "causal_relations", *times(), F.lit(True).alias("is_fact"), F.lit(None).cast("long").alias("own_date"), F.lit(None).cast("array<struct<document_id:string,fact_index:bigint>>").alias("sources"))
    seen = found.observations.withColumns({"document_id": F.col("file"), "nth": F.col("position").cast("long")}).join(bad, ["archive", "document_id", "nth"], "left_anti").join(named, "archive")
    seen = seen.select("archive", "bank_id", F.col("file").alias("document_id"), F.col("nth").alias("fact_index"), F.lit("observation").alias("fact_type"), "text", F.lit(None).cast("string").alias("context"), F.lit(None).cast(dict(facts.dtypes)["causal_relations"]).alias("causal_relations"), *times(), F.lit(False).alias("is_fact"), iso_ms(F.col("event_date")).cast("long").alias("own_date"), "sources")
    rows = facts.unionByName(seen).withColumn("event_date", F.coalesce("occurred_start", "mentioned_at", "own_date"))
    nodes = materialise(insert_nodes(rows, stored.select("id"), ["document_id", "fact_index"]), "imported")
    of_facts = nodes.filter("is_fact")
    asked = nodes.filter("not is_fact").select("archive", F.col("id").alias("observation_id"), F.explode("sources").alias("s")).select("archive", "observation_id", "s.*").distinct()
    backed = asked.join(of_facts.select("archive", "document_id", "fact_index", F.col("id").alias("source_id")), ["archive", "document_id", "fact_index"]).select("observation_id", "source_id")
    proof = C.proof_counts(nodes, backed)
    return {
        "documents": found.documents.join(named, "archive").select("bank_id", "document_id", "original_text", F.sha2("original_text", 256).alias("content_hash")),
        "nodes": nodes.withColumn("document_id", F.when(F.col("is_fact"), F.col("document_id"))).drop("causal_relations", "sources", "own_date", "is_fact").join(proof, "id"),
        "sources": backed,
        "causal": G.causal_links(of_facts, of_facts),
        "temporal": G.temporal_links(nodes),
        "watermarks": nodes.groupBy("bank_id").agg(F.max("id").alias("watermark")),
    }


@query(
    "v3_import",
    """WITH f AS (SELECT * FROM archive_facts QUALIFY row_number() OVER (PARTITION BY document_id, fact_index ORDER BY row_id) = 1),
n AS (SELECT *, row_number() OVER (ORDER BY bank_id, document_id, fact_index) AS id FROM f WHERE trim(coalesce(text, '')) <> '' AND fact_type IN ('world', 'experience', 'observation') AND (mentioned_at IS NOT NULL OR occurred_start IS NOT NULL OR event_date IS NOT NULL)),
r AS (SELECT DISTINCT document_id, fact_index, unnest(causal_relations).target_fact_index AS t FROM n),
c AS (SELECT x.bank_id, count(*) AS causal FROM (SELECT DISTINCT a.bank_id, a.id, b.id AS b FROM r JOIN n a ON a.document_id = r.document_id AND a.fact_index = r.fact_index JOIN n b ON b.document_id = r.document_id AND b.fact_index = r.t WHERE r.t <> r.fact_index) x GROUP BY 1)
SELECT n.bank_id, count(*) AS nodes, coalesce(any_value(c.causal), 0) AS causal, max(id) - min(id) + 1 AS id_span FROM n LEFT JOIN c ON c.bank_id = n.bank_id GROUP BY 1""",
)
def imported(t: Tables) -> DataFrame:
    made = import_archive(t("archive_facts"), t("memory_nodes"))
    nodes = made["nodes"]
    causal = made["causal"].join(nodes.select(F.col("id").alias("from_node_id"), "bank_id"), "from_node_id").groupBy("bank_id").agg(F.count(F.lit(1)).alias("causal"))
    counted = nodes.groupBy("bank_id").agg(F.count(F.lit(1)).alias("nodes"), (F.max("id") - F.min("id") + 1).alias("id_span"))
    return counted.join(causal, "bank_id", "left").select("bank_id", "nodes", F.coalesce("causal", F.lit(0)).alias("causal"), "id_span")


def consolidation_round(store: R.Store, marks: DataFrame, params: R.RecallParams, round_size: int = 50, batch_size: int = 8) -> dict[str, DataFrame]:
    """What the next round puts before a model: batches of facts, pooled observations and their sources.

    Every fact recalls observations of its bank; a batch's pool is their union,
    first seen first, within 512 tokens.
    """
    facts = materialise(C.batches(C.pending(store.nodes, marks), round_size, batch_size), "batches")
    vectors = store.vectors.select(F.col("node_id").alias("id"), F.col("embedding").alias("vector"))
    asked = facts.join(vectors, "id", "left").select(F.col("id").alias("qid"), "bank_id", "text", "vector", F.lit(None).cast("long").alias("first_ms"), F.lit(None).cast("long").alias("last_ms"))
    found = R.recall(asked, store, R.RecallParams(**{**params.__dict__, "types": ("observation",)}))
    named = facts.select(F.col("id").alias("qid"), F.concat_ws("#", "bank_id", "batch").alias("batch_id"), F.col("place").alias("fact_place"))
    candidates = found.join(named, "qid").select("batch_id", "fact_place", F.col("place").alias("rank"), F.col("node_id").alias("observation_id"), "tokens")
    pool = materialise(C.pool(candidates), "pool")
    sizes = store.nodes.select(F.col("id").alias("fact_id"), T.count_words(F.col("text")).alias("tokens"))
    backed = pool.join(store.sources.withColumnRenamed("source_id", "fact_id"), "observation_id").join(sizes, "fact_id")
    return {"facts": facts, "pool": pool, "sources": C.source_facts(backed)}


@query("c5_round")
def next_round(t: Tables) -> DataFrame:
    made = consolidation_round(D.store(t), C.watermarks(t("bank_reports")), R.RecallParams(now_ms=D.NOW_MS))
    return made["pool"]


@query(
    "i4_tool_inputs",
    """WITH c AS (SELECT row_id, text, context, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '... (+' || (length(text) - 100) || ' chars)' ELSE text END AS command FROM archive_facts),
s AS (SELECT *, length('{"command":' || to_json(command)::VARCHAR || ',"note":' || to_json(coalesce(context, '-'))::VARCHAR || ',"other":' || to_json(command)::VARCHAR || '}') > 250 AS long FROM c)
SELECT row_id, command, CASE WHEN long THEN '_truncated_fields,command' ELSE 'command,note,other' END AS keys, CASE WHEN long THEN '["note","other"]' END AS dropped FROM s""",
)
def tool_inputs(t: Tables) -> DataFrame:
    """A command and two fields that are not among the telling ones; above 250 characters in all they are only named."""
    from mnestra.operators.ingest import compact_tool_input

    given = F.create_map(F.lit("command"), F.col("text"), F.lit("note"), F.coalesce("context", F.lit("-")), F.lit("other"), F.col("text"))
    rows = t("archive_facts").select("row_id", compact_tool_input(given, 100, 250).alias("m"))
    return rows.select("row_id", F.col("m")["command"].alias("command"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.col("m")["_truncated_fields"].alias("dropped"))


@query(
    "u7_prompts",
    """SELECT id, to_json({'first': text, 'second': coalesce(context, '')})::VARCHAR AS twin, CASE WHEN mentioned_at IS NOT NULL THEN 'Mission: keep' || chr(10) || 'Event date: ' || strftime(make_timestamp(mentioned_at * 1000), '%A, %B %d, %Y') || chr(10) || chr(10) || text END AS extraction FROM memory_nodes""",
)
def prompts(t: Tables) -> DataFrame:
    from mnestra.operators.ingest import extraction_prompt

    n = t("memory_nodes")
    return n.select("id", C.twin_prompt(F.col("text"), F.coalesce("context", F.lit(""))).alias("twin"), extraction_prompt(F.col("text"), F.col("mentioned_at"), F.lit("keep")).alias("extraction"))


@query(
    "f15_labels",
    """WITH n AS (SELECT id, text, 'mcp__store__' || split_part('recall_it,Retain,reflect,do_search,extract_all,create_x,delete_x,update_x,get_x,list_x,write,grow', ',', (id % 12 + 1)::INT) AS tool FROM memory_nodes)
SELECT id, CASE WHEN length(text) > 160 THEN substring(text, 1, 159) || '…' ELSE text END AS label, id % 12 < 10 AND id % 5 <> 0 AS operational FROM n""",
)
def labels(t: Tables) -> DataFrame:
    """Ten tools that only operate the store and two that do not; every fifth name has no namespace."""
    tools = F.array(*map(F.lit, ("recall_it", "Retain", "reflect", "do_search", "extract_all", "create_x", "delete_x", "update_x", "get_x", "list_x", "write", "grow")))
    name = F.concat(F.when(F.col("id") % 5 == 0, "store__").otherwise("mcp__store__"), F.element_at(tools, (F.col("id") % 12 + 1).cast("int")))
    return t("memory_nodes").select("id", T.label(F.col("text")).alias("label"), T.operational_tool(name).alias("operational"))
