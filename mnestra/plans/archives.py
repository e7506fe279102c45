"""Queries of archives, their verification, and files around the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.operators import archive as A
from mnestra.operators import metrics as M
from mnestra.operators import store as S
from mnestra.operators import verify as V
from mnestra.operators.ingest import split_turns
from mnestra.operators.retrieval import top
from mnestra.plans import tables as D
from mnestra.plans.ingest import _TURNS
from mnestra.plans.tables import Registry, Tables
from mnestra.session import materialise, shared_dir
from mnestra.sources import files

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_FIELDS = ("text", "fact_type", "context", "event_date", "occurred_start", "occurred_end", "mentioned_at", "metadata", "tags", "chunk_index", "entities", "causal_relations", "created_at", "consolidated_at", "consolidation_failed_at")


def _first_facts(t: Tables) -> DataFrame:
    return top(t("archive_facts"), ["document_id", "fact_index"], [F.col("row_id")], 1, "_n").drop("_n")


def _claims(t: Tables) -> DataFrame:
    """One row an archive: what its reports claim, the highest figure of each, and some that forbid an import."""
    r = t("bank_reports").groupBy("archive_id").agg(F.min("bank_id").alias("source_bank_id"), *[F.max(c).alias(f"{n}_count") for c, n in (("documents", "document"), ("facts", "fact"), ("observations", "observation"))])
    odd = lambda k: (F.col("fact_count") % k == 0)
    return r.withColumns({"schema_version": F.when(odd(7), 2).otherwise(1), "archive_type": F.when(odd(5), "bank").otherwise("documents"), "webhook_count": F.when(odd(3), 1).otherwise(0), "includes_history": odd(11)})


def _files(t: Tables) -> DataFrame:
    claims = _claims(t)
    nodes = t("memory_nodes")
    facts = _first_facts(t).join(claims.select("archive_id"), "archive_id", "left_semi").select("archive_id", "document_id", "fact_index", *_FIELDS)
    texts = t("documents").select(F.col("doc_key").alias("document_id"), F.col("text").alias("original_text"))
    named = nodes.filter("document_id is not null").select(F.col("id").alias("source_id"), F.struct("document_id", "fact_index").alias("s"))
    backed = D.sources(t).join(named, "source_id").groupBy(F.col("observation_id").alias("id")).agg(F.array_sort(F.collect_set("s")).alias("sources"))
    at = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    seen = nodes.filter("fact_type = 'observation'").join(claims.select("archive_id", F.col("source_bank_id").alias("bank_id")), "bank_id").drop("archive_id_").select(claims["archive_id"], "id", "text", at("event_date"), at("occurred_start"), at("mentioned_at"), "proof_count")
    return A.archive_files(facts, texts, seen.join(backed, "id", "left"), claims)


def _archive(t: Tables) -> A.Archive:
    return A.parse_archive(materialise(_files(t), "archive-files"))


_F = """claims AS (SELECT archive_id, min(bank_id) AS bank_id, max(documents) AS documents, max(facts) AS facts, max(observations) AS observations FROM bank_reports GROUP BY 1),
f0 AS (SELECT * FROM archive_facts QUALIFY row_number() OVER (PARTITION BY document_id, fact_index ORDER BY row_id) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY archive_id, document_id ORDER BY fact_index) - 1 AS place, count(*) OVER (PARTITION BY archive_id, document_id) AS n_facts FROM f0 WHERE archive_id IN (SELECT archive_id FROM claims))"""
_O = f"""{D.SOURCES}, ob AS (SELECT c.archive_id, n.id, n.event_date, n.occurred_start, n.mentioned_at, c.archive_id || '/observations-' || (n.id // 500) || '.json' AS file, row_number() OVER (PARTITION BY c.archive_id, n.id // 500 ORDER BY n.id) - 1 AS place FROM memory_nodes n JOIN claims c ON c.bank_id = n.bank_id WHERE n.fact_type = 'observation'),
os AS (SELECT ob.archive_id, ob.id, ob.file, ob.place, n.document_id, n.fact_index FROM ob JOIN sources s ON s.observation_id = ob.id JOIN memory_nodes n ON n.id = s.source_id AND n.document_id IS NOT NULL)"""


@query("s3_archive", f"WITH {_F} SELECT archive_id AS archive, document_id, place AS fact_index, text, fact_type, mentioned_at, coalesce(len(entities), 0) AS entities, coalesce(len(causal_relations), 0) AS causes FROM f")
def archive_facts(t: Tables) -> DataFrame:
    rows = _archive(t).facts
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias
    return rows.select("archive", "document_id", "fact_index", "text", "fact_type", "mentioned_at", count("entities")("entities"), count("causal_relations")("causes"))


@query("s3_observations", f"WITH {_F}, {_O} SELECT ob.archive_id AS archive, ob.file, ob.place AS position, count(os.id) AS sources FROM ob LEFT JOIN (SELECT DISTINCT archive_id, id, document_id, fact_index FROM os) os ON os.id = ob.id GROUP BY ALL")
def archive_observations(t: Tables) -> DataFrame:
    rows = _archive(t).observations
    return rows.select("archive", "file", "position", F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0)).alias("sources"))


@query(
    "v1_integrity",
    f"""WITH {_F}, {_O}, docs AS (SELECT archive_id, document_id, any_value(n_facts) AS n FROM f GROUP BY ALL),
k AS (SELECT d.doc_key, d.text, d.doc_id % 50 = 0 AS altered, (SELECT count(DISTINCT fact_index) FROM memory_nodes m WHERE m.document_id = d.doc_key) AS facts FROM documents d)
SELECT 'schema_version' AS rule, archive_id AS archive, NULL AS document_id, NULL::BIGINT AS place FROM claims WHERE facts % 7 = 0
UNION ALL SELECT 'document_count', c.archive_id, NULL, NULL FROM claims c WHERE c.documents IS DISTINCT FROM (SELECT count(*) FROM docs WHERE docs.archive_id = c.archive_id)
UNION ALL SELECT 'fact_count', c.archive_id, NULL, NULL FROM claims c WHERE c.facts IS DISTINCT FROM (SELECT count(*) FROM f WHERE f.archive_id = c.archive_id)
UNION ALL SELECT 'observation_count', c.archive_id, NULL, NULL FROM claims c WHERE c.observations IS DISTINCT FROM (SELECT count(*) FROM ob WHERE ob.archive_id = c.archive_id)
UNION ALL SELECT 'no_original_text', archive_id, document_id, NULL FROM docs LEFT JOIN k ON k.doc_key = docs.document_id WHERE k.text IS NULL
UNION ALL SELECT 'observation_without_sources', archive_id, file, place FROM ob WHERE id NOT IN (SELECT id FROM os)
UNION ALL SELECT 'unknown_document', archive_id, document_id, NULL FROM docs WHERE document_id NOT IN (SELECT doc_key FROM documents)
UNION ALL SELECT 'content_hash', archive_id, document_id, NULL FROM docs JOIN k ON k.doc_key = docs.document_id WHERE k.altered AND k.text IS NOT NULL
UNION ALL SELECT 'facts_of_document', archive_id, document_id, NULL FROM docs JOIN k ON k.doc_key = docs.document_id WHERE docs.n <> k.facts""",
)
def integrity(t: Tables) -> DataFrame:
    """The store's documents stand for the system that the archive came from; every fiftieth has another text there."""
    counts = t("memory_nodes").filter("document_id is not null").groupBy("document_id").agg(F.countDistinct("fact_index").alias("facts"))
    known = t("documents").select(F.col("doc_key").alias("document_id"), F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return A.integrity(_archive(t), known.join(counts, "document_id", "left").fillna(0, ["facts"])).select("rule", "archive", "document_id", "place")


@query(
    "v2_importable",
    f"""WITH {_F}, {_O}
SELECT 'archive_type' AS rule, archive_id AS archive, NULL AS document_id, NULL::BIGINT AS place FROM claims WHERE facts % 5 = 0
UNION ALL SELECT 'webhook_count', archive_id, NULL, NULL FROM claims WHERE facts % 3 = 0
UNION ALL SELECT 'includes_history', archive_id, NULL, NULL FROM claims WHERE facts % 11 = 0
UNION ALL SELECT DISTINCT 'cause_out_of_range', archive_id, document_id, place FROM (SELECT archive_id, document_id, place, n_facts, unnest(causal_relations).target_fact_index AS target FROM f) WHERE target < 0 OR target >= n_facts
UNION ALL SELECT 'unknown_type', archive_id, document_id, place FROM f WHERE NOT coalesce(fact_type IN ('world', 'experience', 'observation'), false)
UNION ALL SELECT 'no_date', archive_id, document_id, place FROM f WHERE occurred_start IS NULL AND mentioned_at IS NULL
UNION ALL SELECT 'no_date_of_observation', archive_id, file, place FROM ob WHERE coalesce(occurred_start, mentioned_at, event_date) IS NULL
UNION ALL SELECT DISTINCT 'source_unresolved', os.archive_id, os.file, os.place FROM os WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.archive_id = os.archive_id AND f.document_id = os.document_id AND f.place = os.fact_index)""",
)
def importable(t: Tables) -> DataFrame:
    return A.importable(_archive(t))


@query(
    "v3_whole_import",
    f"""WITH {_F}, {_O}, ok AS (SELECT archive_id, bank_id FROM claims WHERE facts % 5 <> 0 AND facts % 3 <> 0 AND facts % 11 <> 0),
n AS (SELECT f.*, ok.bank_id AS bank FROM f JOIN ok ON ok.archive_id = f.archive_id WHERE coalesce(occurred_start, mentioned_at) IS NOT NULL),
o AS (SELECT ob.* FROM ob JOIN ok ON ok.archive_id = ob.archive_id WHERE coalesce(ob.occurred_start, ob.mentioned_at, ob.event_date) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM os WHERE os.id = ob.id AND NOT EXISTS (SELECT 1 FROM f WHERE f.archive_id = os.archive_id AND f.document_id = os.document_id AND f.place = os.fact_index))),
s AS (SELECT DISTINCT os.archive_id, os.id, n.document_id, n.place FROM os JOIN o ON o.id = os.id JOIN n ON n.archive_id = os.archive_id AND n.document_id = os.document_id AND n.place = os.fact_index),
c AS (SELECT DISTINCT x.archive_id, x.document_id, x.place, y.place AS goal FROM (SELECT archive_id, document_id, place, unnest(causal_relations).target_fact_index AS target FROM n) x JOIN n y ON y.archive_id = x.archive_id AND y.document_id = x.document_id AND y.place = x.target WHERE x.place <> x.target)
SELECT ok.bank_id, (SELECT count(DISTINCT document_id) FROM f WHERE f.archive_id = ok.archive_id) AS documents, (SELECT count(*) FROM n WHERE n.archive_id = ok.archive_id) AS facts, (SELECT count(*) FROM o WHERE o.archive_id = ok.archive_id) AS observations,
(SELECT count(*) FROM s WHERE s.archive_id = ok.archive_id) AS proofs, (SELECT count(*) FROM c WHERE c.archive_id = ok.archive_id) AS causal FROM ok""",
)
def whole_import(t: Tables) -> DataFrame:
    from mnestra.plans.pipelines import import_whole

    made = import_whole(_archive(t), t("memory_nodes"))
    nodes = made["nodes"]
    counts = nodes.groupBy("bank_id").agg(F.count("document_id").alias("facts"), F.count_if(F.col("document_id").isNull()).alias("observations"), F.sum("proof_count").alias("proofs"))
    causal = made["causal"].join(nodes.select(F.col("id").alias("from_node_id"), "bank_id"), "from_node_id").groupBy("bank_id").agg(F.count(F.lit(1)).alias("causal"))
    return made["documents"].groupBy("bank_id").agg(F.count(F.lit(1)).alias("documents")).join(counts, "bank_id").join(causal, "bank_id", "left").fillna(0)


_SIMPLE = "SELECT archive_id, '{0}' AS c, 0 AS e, count(*) AS a FROM {1} GROUP BY 1"
_CHECKS = f"""WITH {D.MEMBERS}, {D.TAGS}, {D.SOURCES}, asked AS (SELECT archive_id, min(bank_id) AS bank_id, max(watermark) AS watermark, max(node_sources) AS node_sources FROM bank_reports GROUP BY 1),
uf AS (SELECT archive_id, document_id, fact_index, min(fact_type) AS fact_type, any_value(tags) AS tags, any_value(causal_relations) AS causal_relations FROM archive_facts GROUP BY 1, 2, 3),
held AS (SELECT * FROM memory_nodes WHERE archive_id IS NOT NULL), ul AS (SELECT DISTINCT from_node_id, to_node_id, link_type FROM links),
nm AS (SELECT DISTINCT archive_id, document_id, fact_index, {D._TRIM.format("e")} AS name FROM (SELECT archive_id, document_id, fact_index, unnest(entities) AS e FROM archive_facts) WHERE {D._TRIM.format("e")} <> ''),
mb AS (SELECT DISTINCT h.archive_id, m.node_id, m.entity_id FROM members m JOIN held h ON h.id = m.node_id),
dn AS (SELECT u.archive_id, u.document_id, count(*) AS e, (SELECT count(*) FROM held h WHERE h.archive_id = u.archive_id AND h.document_id = u.document_id) AS a FROM uf u GROUP BY 1, 2),
td AS (SELECT h.archive_id, x.from_node_id FROM (__TEMPORAL__) x JOIN held h ON h.id = x.from_node_id),
r AS (SELECT archive_id, 'banks' AS c, 1 AS e, CASE WHEN bank_id IN (SELECT bank_id FROM banks) THEN 1 ELSE 0 END AS a FROM asked
UNION ALL SELECT archive_id, 'documents', count(DISTINCT document_id), 0 FROM uf GROUP BY 1 UNION ALL SELECT archive_id, 'documents', 0, count(DISTINCT document_id) FROM held GROUP BY 1
UNION ALL SELECT archive_id, 'nodes', count(*), 0 FROM uf GROUP BY 1 UNION ALL {_SIMPLE.format("nodes", "held")}
UNION ALL SELECT archive_id, 'nodes.' || fact_type, count(*), 0 FROM uf GROUP BY 1, 2 UNION ALL SELECT archive_id, 'nodes.' || fact_type, 0, count(*) FROM held GROUP BY 1, 2
UNION ALL SELECT n.archive_id, 'caused_by', count(*), 0 FROM (SELECT DISTINCT archive_id, document_id, fact_index, target FROM (SELECT archive_id, document_id, fact_index, unnest(causal_relations).target_fact_index AS target FROM uf) WHERE target <> fact_index) n JOIN uf u ON u.archive_id = n.archive_id AND u.document_id = n.document_id AND u.fact_index = n.target GROUP BY 1
UNION ALL SELECT h.archive_id, 'caused_by', 0, count(*) FROM ul JOIN held h ON h.id = ul.from_node_id WHERE link_type = 'caused_by' AND to_node_id IN (SELECT id FROM held) GROUP BY 1
UNION ALL SELECT archive_id, 'node_sources', node_sources, 0 FROM asked UNION ALL SELECT q.archive_id, 'node_sources', 0, count(*) FROM sources s JOIN memory_nodes o ON o.id = s.observation_id JOIN asked q ON q.bank_id = o.bank_id GROUP BY 1
UNION ALL SELECT archive_id, 'node_tags', sum(len(list_distinct(tags))), 0 FROM uf GROUP BY 1 UNION ALL SELECT h.archive_id, 'node_tags', 0, count(*) FROM tagged g JOIN held h ON h.id = g.node_id GROUP BY 1
UNION ALL SELECT archive_id, 'entities', count(DISTINCT name), 0 FROM nm GROUP BY 1 UNION ALL SELECT archive_id, 'entities', 0, count(DISTINCT entity_id) FROM mb GROUP BY 1
UNION ALL SELECT archive_id, 'node_entities', count(*), 0 FROM nm GROUP BY 1 UNION ALL {_SIMPLE.format("node_entities", "mb")}
UNION ALL SELECT archive_id, 'documents_with_their_facts', count(*), count(*) FILTER (e = a) FROM dn GROUP BY 1
UNION ALL SELECT archive_id, 'import_marker', 1, CASE WHEN bank_id IN (SELECT bank_id FROM banks WHERE disposition::JSON ->> '$.import.state' = 'done') THEN 1 ELSE 0 END FROM asked
UNION ALL SELECT archive_id, 'watermark', 1, CASE WHEN watermark >= coalesce((SELECT max(id) FROM held h WHERE h.archive_id = asked.archive_id), 0) THEN 1 ELSE 0 END FROM asked
UNION ALL SELECT archive_id, 'embedding_coverage', 0, count(*) FROM held WHERE id NOT IN (SELECT node_id FROM node_vectors WHERE embedding IS NOT NULL AND embedding_model = 'mini-embed-v2') GROUP BY 1
UNION ALL SELECT archive_id, 'orphan_facts', 0, count(*) FROM held WHERE document_id IS NULL AND fact_type <> 'observation' GROUP BY 1
UNION ALL SELECT h.archive_id, 'semantic_from_observations', 0, count(*) FROM ul JOIN held h ON h.id = ul.from_node_id AND h.fact_type = 'observation' WHERE link_type = 'semantic' GROUP BY 1
UNION ALL {_SIMPLE.format("temporal_consistency", "td")}),
names AS (SELECT unnest(['banks', 'documents', 'nodes', 'nodes.world', 'nodes.experience', 'nodes.observation', 'caused_by', 'node_sources', 'node_tags', 'entities', 'node_entities', 'documents_with_their_facts', 'import_marker', 'watermark', 'embedding_coverage', 'orphan_facts', 'semantic_from_observations', 'temporal_consistency']) AS c),
chk AS (SELECT q.archive_id, n.c AS "check", coalesce(sum(r.e), 0)::BIGINT AS expected, coalesce(sum(r.a), 0)::BIGINT AS actual FROM asked q CROSS JOIN names n LEFT JOIN r ON r.archive_id = q.archive_id AND r.c = n.c GROUP BY ALL)"""


def _checks_sql() -> str:
    from mnestra.plans.graph import ORACLE as other

    return _CHECKS.replace("__TEMPORAL__", other["v5_temporal_differences"])


def _checks(t: Tables) -> DataFrame:
    return A.count_checks(t("archive_facts"), t("bank_reports"), t("banks"), t("memory_nodes"), t("links"), t("node_vectors"), D.node_tags(t), D.node_entities(t).select("node_id", "entity_id"), D.sources(t), "mini-embed-v2")


@query("a17_count_checks", f"""{_checks_sql()} SELECT *, CASE WHEN expected = actual THEN 'pass' ELSE 'fail' END AS state FROM chk""")
def count_checks(t: Tables) -> DataFrame:
    return _checks(t)


@query("v6_verdicts", f"""{_checks_sql()} SELECT archive_id, CASE WHEN bool_or(expected <> actual AND "check" NOT IN ('import_marker', 'watermark')) THEN 'fail' WHEN bool_or(expected <> actual) THEN 'review' ELSE 'pass' END AS verdict FROM chk GROUP BY 1""")
def verdicts(t: Tables) -> DataFrame:
    mild = F.col("check").isin("import_marker", "watermark")
    return V.verdict(_checks(t).withColumn("state", F.when((F.col("state") == "fail") & mild, "review").otherwise(F.col("state"))), ["archive_id"])


@query(
    "a18_ratios",
    """WITH e AS (SELECT archive_id, count(DISTINCT (document_id, fact_index)) AS n FROM archive_facts GROUP BY 1), a AS (SELECT archive_id, count(*) AS n FROM memory_nodes WHERE archive_id IS NOT NULL GROUP BY 1)
SELECT q.archive_id, CASE WHEN e.n IS NULL OR a.n IS NULL THEN 'review' WHEN a.n / e.n::DOUBLE BETWEEN 0.98 AND 1.01 THEN 'pass' ELSE 'fail' END AS state FROM (SELECT DISTINCT archive_id FROM bank_reports) q LEFT JOIN e ON e.archive_id = q.archive_id LEFT JOIN a ON a.archive_id = q.archive_id""",
)
def ratios(t: Tables) -> DataFrame:
    e = t("archive_facts").groupBy("archive_id").agg(F.countDistinct("document_id", "fact_index").alias("e"))
    a = t("memory_nodes").filter("archive_id is not null").groupBy("archive_id").agg(F.count(F.lit(1)).alias("a"))
    rows = t("bank_reports").select("archive_id").distinct().join(e, "archive_id", "left").join(a, "archive_id", "left")
    return rows.select("archive_id", V.in_band(F.col("a") / F.col("e"), 0.98, 1.01).alias("state"))


_KEYED = "SELECT document_id || '#' || fact_index AS k, * FROM"


@query(
    "v4_field_differences",
    f"""WITH n0 AS ({_KEYED} memory_nodes WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, fact_index ORDER BY id) = 1),
s AS (SELECT bank_id, greatest(1, floor(2000 * count(*) / (SELECT count(*) FROM n0)::DOUBLE + 0.5::DOUBLE)) AS quota FROM n0 GROUP BY 1),
m AS (SELECT n0.* FROM n0 JOIN s ON s.bank_id = n0.bank_id QUALIFY row_number() OVER (PARTITION BY n0.bank_id ORDER BY md5('3:' || n0.k), n0.k) <= any_value(s.quota) OVER (PARTITION BY n0.bank_id)),
f AS ({_KEYED} archive_facts QUALIFY row_number() OVER (PARTITION BY document_id, fact_index ORDER BY row_id) = 1)
SELECT k, 'text' AS field, f.text AS left_value, m.text AS right_value FROM f JOIN m USING (k) WHERE f.text IS DISTINCT FROM m.text
UNION ALL SELECT k, 'fact_type', f.fact_type, m.fact_type FROM f JOIN m USING (k) WHERE f.fact_type IS DISTINCT FROM m.fact_type
UNION ALL SELECT k, 'context', f.context, m.context FROM f JOIN m USING (k) WHERE f.context IS DISTINCT FROM m.context""",
)
def field_differences(t: Tables) -> DataFrame:
    key = F.concat_ws("#", "document_id", "fact_index").alias("k")
    nodes = top(t("memory_nodes").filter("document_id is not null"), ["document_id", "fact_index"], [F.col("id")], 1, "_n").select(key, "bank_id", "text", "fact_type", "context")
    sample = V.stratified_sample(nodes, "bank_id", "k", 2000, 3)  # the feature is a sample
    return A.field_differences(_first_facts(t).select(key, "text", "fact_type", "context"), sample, "k", ["text", "fact_type", "context"])


@query(
    "v7_baselines",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY reported_at DESC, archive_id, facts) AS n FROM bank_reports), b AS (SELECT * FROM r WHERE n = 2)
SELECT r.bank_id, r.facts, b.facts AS baseline, r.facts IS NOT DISTINCT FROM b.facts AS same FROM r LEFT JOIN b ON b.bank_id = r.bank_id WHERE r.n = 1""",
)
def baselines(t: Tables) -> DataFrame:
    placed = top(t("bank_reports"), ["bank_id"], [F.desc("reported_at"), F.col("archive_id"), F.col("facts")], 2, "n")
    return V.against_baseline(placed.filter("n = 2").withColumn("order", -F.col("n")), placed.filter("n = 1").select("bank_id", "facts"), ["bank_id"], "order", "facts")


@query("j11_legacy_join", "SELECT f.row_id, n.id FROM archive_facts f JOIN memory_nodes n ON n.document_id = f.document_id AND n.fact_index = f.fact_index WHERE n.id % 2 = 0")
def legacy_join(t: Tables) -> DataFrame:
    path = F.to_json(F.struct(F.struct("document_id", "fact_index").alias("legacy")))
    nodes = t("memory_nodes").select("id", F.when(F.col("id") % 2 == 0, path).otherwise(F.col("metadata")).alias("metadata"))
    return A.legacy_join(t("archive_facts"), nodes)


@query(
    "u1_delete_banks",
    """WITH gone AS (SELECT bank_id FROM banks WHERE mission IS NULL), dead AS (SELECT id FROM memory_nodes WHERE bank_id IN (FROM gone)), lost AS (SELECT doc_key FROM documents WHERE bank_id IN (FROM gone))
SELECT 'banks' AS name, count(*) AS rows, count(bank_id) AS marked FROM banks WHERE mission IS NOT NULL
UNION ALL SELECT 'documents', count(*), count(bank_id) FROM documents WHERE bank_id NOT IN (FROM gone) OR bank_id IS NULL
UNION ALL SELECT 'memory_nodes', count(*), count(CASE WHEN document_id NOT IN (FROM lost) THEN 1 END) FROM memory_nodes WHERE bank_id NOT IN (FROM gone) OR bank_id IS NULL
UNION ALL SELECT 'links', count(*), count(*) FROM links WHERE from_node_id NOT IN (FROM dead) AND to_node_id NOT IN (FROM dead)
UNION ALL SELECT 'node_vectors', count(*), count(*) FROM node_vectors WHERE node_id NOT IN (FROM dead)
UNION ALL SELECT 'entities', count(*), count(bank_id) FROM entities WHERE bank_id NOT IN (FROM gone) OR bank_id IS NULL
UNION ALL SELECT 'mental_refreshes', count(*), count(bank_id) FROM mental_refreshes WHERE bank_id NOT IN (FROM gone) OR bank_id IS NULL
UNION ALL SELECT 'bank_reports', count(*), count(CASE WHEN bank_id NOT IN (FROM gone) THEN 1 END) FROM bank_reports""",
)
def delete_banks(t: Tables) -> DataFrame:
    left = S.delete_cascade(
        t("banks").filter("mission is null"), t("banks"), t("memory_nodes"), t("documents"), t("links"),
        {n: t(n) for n in ("entities", "mental_refreshes")}, {"node_vectors": t("node_vectors")}, {"bank_reports": t("bank_reports")},
    )
    mark = {"memory_nodes": "document_id", "links": "from_node_id", "node_vectors": "node_id"}
    out = None
    for name, df in left.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.count(mark.get(name, "bank_id")).alias("marked"))
        out = row if out is None else out.unionByName(row)
    return out


# --- files ----------------------------------------------------------------------------------------


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t('banks').sparkSession)}/mnestra-{name}-{uuid.uuid4().hex}"


_LOG = f"""WITH {_TURNS}, l AS (SELECT doc_id, turn, role, content, to_json({{'role': role, 'content': content}})::VARCHAR AS m FROM turns),
w AS (SELECT *, '{{"type":"' || role || '","message":' || m || '}}' AS line FROM l)"""


def _logs(t: Tables) -> DataFrame:
    """A session log a transcript: its turns as lines, a mark of compaction, and a torn line at the end."""
    said = split_turns(t("documents"))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","message":'), F.to_json(F.struct("role", "content")), F.lit("}"))
    lines = said.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("v")))), lambda x: x["v"]), "\n").alias("t"))
    text = F.concat("t", F.lit('\n{"type":"system","subtype":"compact_boundary"}\n{"type":"user","mess'))
    return lines.select(F.col("doc_id").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))


@query(
    "s1_states",
    f"""{_LOG} SELECT doc_id::VARCHAR AS path, sum(strlen(line) + 1)::BIGINT + 47 AS consumed_to, 1 AS compactions, coalesce(sum(strlen(m) + 1) FILTER (role IN ('user', 'assistant')), 0) + 1 > 1500 AS truncated FROM w GROUP BY doc_id""",
)
def log_states(t: Tables) -> DataFrame:
    return files.read_delta(_logs(t), 0, 1500)[1]


@query(
    "s1_messages",
    f"""{_LOG} SELECT doc_id::VARCHAR AS path, turn AS line_no, role, content FROM w WHERE role IN ('user', 'assistant') QUALIFY sum(strlen(m) + 1) OVER (PARTITION BY doc_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 1499""",
)
def log_messages(t: Tables) -> DataFrame:
    return files.read_delta(_logs(t), 0, 1500)[0].select("path", "line_no", "role", "content")


@query("s4_corpus_read", "SELECT document_id || '#' || fact_index AS id, text, fact_type, len(tags) AS tags FROM archive_facts QUALIFY row_number() OVER (PARTITION BY document_id, fact_index ORDER BY row_id) = 1")
def corpus_read(t: Tables) -> DataFrame:
    path = _folder(t, "corpus")
    files.append_json(files.export_corpus(t("archive_facts")), path)
    return files.read_corpus(t("banks").sparkSession, path).select("id", "text", "fact_type", F.size("tags").alias("tags"))


@query("s5_gold", "SELECT from_node_id AS qid, to_node_id AS uuid, max(CASE WHEN weight >= 0.8 THEN 2 WHEN weight >= 0.5 THEN 1 ELSE 0 END) AS grade FROM links WHERE link_type = 'semantic' GROUP BY ALL")
def gold(t: Tables) -> DataFrame:
    grade = F.max(F.when(F.col("weight") >= 0.8, 2).when(F.col("weight") >= 0.5, 1).otherwise(0)).alias("grade")
    labels = t("links").filter("link_type = 'semantic'").groupBy("from_node_id", "to_node_id").agg(grade)
    label = F.struct(F.col("to_node_id").cast("string").alias("uuid"), "grade", F.lit("linked").alias("why"))
    rows = labels.groupBy(F.col("from_node_id").cast("string").alias("id")).agg(F.lit("links").alias("stratum"), F.lit("?").alias("query"), F.collect_list(label).alias("labels"))
    path = _folder(t, "gold")
    files.append_json(rows, path)
    read = files.read_gold(t("banks").sparkSession, path)
    return read.select(F.col("qid").cast("long").alias("qid"), F.col("uuid").cast("long").alias("uuid"), "grade")


@query("s7_checksums", "SELECT doc_key AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'new' END AS state FROM documents WHERE text IS NOT NULL AND (doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 13 = 0)")
def checksums(t: Tables) -> DataFrame:
    """The texts of documents stand for files: some are gone, some have changed, some are new."""
    texts = t("documents").filter("text is not null").select("doc_id", F.col("doc_key").alias("path"), "text")
    fresh = (F.col("doc_id") % 13 == 0) & (F.col("doc_id") % 11 != 0) & (F.col("doc_id") % 7 != 0)
    before = texts.filter(~fresh).select("path", F.sha2("text", 256).alias("sha256"))
    after = texts.filter("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return files.checksum_differences(before, after)


@query("s13_ledger", "SELECT bank_id, 2 * count(*) AS runs, max(facts) AS most FROM bank_reports GROUP BY 1")
def ledger(t: Tables) -> DataFrame:
    path = _folder(t, "ledger")
    for _ in range(2):
        files.append_json(t("bank_reports").select("bank_id", "facts"), path)
    read = t("banks").sparkSession.read.schema("bank_id string, facts long").json(path)
    return read.groupBy("bank_id").agg(F.count(F.lit(1)).alias("runs"), F.max("facts").alias("most"))


@query("s13_pools", "SELECT from_node_id AS qid, '[' || string_agg('{\"rank\":' || r || ',\"node_id\":' || to_node_id || '}', ',' ORDER BY r) || ']' AS pool FROM (SELECT from_node_id, to_node_id, row_number() OVER (PARTITION BY from_node_id ORDER BY to_node_id) AS r FROM (SELECT DISTINCT from_node_id, to_node_id FROM links)) GROUP BY 1")
def pools(t: Tables) -> DataFrame:
    ranked = top(t("links").select(F.col("from_node_id").alias("qid"), F.col("to_node_id").alias("node_id")).distinct(), ["qid"], [F.col("node_id")], None)
    return files.pool_dump(ranked)


@query("s14_rotated", "SELECT log, count(*) AS rows FROM bank_reports, (VALUES ('1'), ('2'), ('current')) v(log) GROUP BY 1")
def rotated(t: Tables) -> DataFrame:
    """Four writes to a log that is full after each: the oldest is gone when two old ones are kept."""
    path, spark = _folder(t, "log"), t("banks").sparkSession
    for _ in range(4):
        files.append_rotated(t("bank_reports").select("bank_id", "facts"), path, 10, 2)
    logs = [spark.read.schema("bank_id string, facts long").json(f"{path}/{name}").select(F.lit(name).alias("log")) for name in ("1", "2", "current")]
    return logs[0].union(logs[1]).union(logs[2]).groupBy("log").agg(F.count(F.lit(1)).alias("rows"))


@query("s12_responses", "SELECT archive_id, '{' || concat_ws(',', '\"bank_id\":' || to_json(bank_id)::VARCHAR, '\"documents\":' || documents, '\"facts\":' || facts, '\"skipped_empty\":' || skipped_empty) || '}' AS body FROM bank_reports")
def responses(t: Tables) -> DataFrame:
    return files.json_responses(t("bank_reports").select("archive_id", "bank_id", "documents", "facts", "skipped_empty"), "archive_id")


@query("l3_clamped", "SELECT bank_id, id, row_number() OVER (PARTITION BY bank_id ORDER BY id DESC) AS nth FROM memory_nodes QUALIFY nth <= 1000")
def clamped(t: Tables) -> DataFrame:
    """A limit of a million is held at a thousand."""
    return M.newest(t("memory_nodes").select("bank_id", "id"), ["bank_id"], "id", 1_000_000)
