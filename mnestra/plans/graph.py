"""Queries of the fact graph, banks, entities, curation and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.functions import cron
from mnestra.functions import text as T
from mnestra.operators import curation as C
from mnestra.operators import entities as E
from mnestra.operators import graph as G
from mnestra.operators import store as S
from mnestra.operators import verify as V
from mnestra.operators.retrieval import top
from mnestra.plans import tables as D
from mnestra.plans.tables import NOW_MS, Registry, Tables

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_ULINKS = "ul AS (SELECT DISTINCT from_node_id, to_node_id, link_type, entity_id FROM links)"
_INSIDE = f"{_ULINKS}, ins AS (SELECT a.bank_id, ul.*, a.fact_type AS ft, b.fact_type AS tt FROM ul JOIN memory_nodes a ON a.id = ul.from_node_id JOIN memory_nodes b ON b.id = ul.to_node_id AND b.bank_id = a.bank_id)"
_COMP = f"""{_INSIDE},
e2 AS (SELECT from_node_id AS a, to_node_id AS b FROM ins UNION SELECT to_node_id, from_node_id FROM ins),
reach(node_id, other) AS (SELECT id, id FROM memory_nodes UNION SELECT r.node_id, e2.b FROM reach r JOIN e2 ON e2.a = r.other),
comp AS (SELECT n.bank_id, r.node_id, min(r.other) AS component, any_value(n.fact_type) AS fact_type FROM reach r JOIN memory_nodes n ON n.id = r.node_id GROUP BY ALL)"""


@query(
    "g1_temporal_links",
    f"""WITH b AS (SELECT DISTINCT id, bank_id, fact_type, event_date FROM memory_nodes WHERE event_date IS NOT NULL),
p AS (SELECT x.id AS from_node_id, y.id AS to_node_id, greatest(0.3::DOUBLE, 1 - abs(x.event_date - y.event_date) / {D.DAY_MS}.0::DOUBLE) AS w FROM b x JOIN b y ON y.bank_id = x.bank_id AND y.fact_type = x.fact_type AND y.id <> x.id
      AND y.event_date BETWEEN x.event_date - {D.DAY_MS} AND x.event_date + {D.DAY_MS})
SELECT from_node_id, to_node_id, round(w, 6) AS weight FROM p QUALIFY row_number() OVER (PARTITION BY from_node_id ORDER BY w DESC, to_node_id) <= 20""",
)
def temporal_links(t: Tables) -> DataFrame:
    return G.temporal_links(t("memory_nodes"))


@query(
    "g2_causal_links",
    """WITH r AS (SELECT DISTINCT document_id, fact_index, unnest(causal_relations).target_fact_index AS target FROM archive_facts)
SELECT DISTINCT a.id AS from_node_id, b.id AS to_node_id, 'caused_by' AS link_type, 1.0::DOUBLE AS weight FROM r JOIN memory_nodes a ON a.document_id = r.document_id AND a.fact_index = r.fact_index
JOIN memory_nodes b ON b.document_id = r.document_id AND b.fact_index = r.target WHERE r.target <> r.fact_index AND a.id <> b.id""",
)
def causal_links(t: Tables) -> DataFrame:
    return G.causal_links(t("archive_facts"), t("memory_nodes").filter("document_id is not null"))


@query(
    "g3_semantic_links",
    f"""WITH {D.VECTORS}, ty AS (SELECT v.*, n.fact_type FROM vecs v JOIN memory_nodes n ON n.id = v.node_id),
k AS (SELECT q.node_id AS f, v.node_id AS t, q.fact_type AS ft, v.fact_type AS tt, round(list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(v.v, v.v)), 6) AS s FROM ty q JOIN ty v ON v.bank_id = q.bank_id AND len(v.v) = len(q.v)
      QUALIFY row_number() OVER (PARTITION BY q.node_id ORDER BY s DESC, v.node_id) <= 100)
SELECT f AS from_node_id, t AS to_node_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, s)) AS weight FROM k WHERE s >= 0.7 AND f <> t AND ft = tt QUALIFY row_number() OVER (PARTITION BY f ORDER BY s DESC, t) <= 20""",
)
def semantic_links(t: Tables) -> DataFrame:
    vectors = D.vectors(t).join(t("memory_nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return G.semantic_links(vectors, t("memory_nodes"))


@query(
    "g4_insert_links",
    """WITH r AS (SELECT from_node_id, to_node_id, link_type, entity_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, weight)) AS weight, created_at, 0 AS turn FROM links
UNION ALL SELECT to_node_id, from_node_id, 'semantic', entity_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, weight)), created_at + 1, 1 FROM links WHERE link_type = 'semantic')
SELECT from_node_id, to_node_id, link_type, entity_id, weight, created_at FROM r QUALIFY row_number() OVER (PARTITION BY from_node_id, to_node_id, link_type, entity_id ORDER BY turn, created_at, weight) = 1""",
)
def insert_links(t: Tables) -> DataFrame:
    links = t("links")
    back = links.filter("link_type = 'semantic'").select(F.col("to_node_id").alias("from_node_id"), F.col("from_node_id").alias("to_node_id"), "link_type", "entity_id", "weight", (F.col("created_at") + 1).alias("created_at"))
    return G.insert_links(links, back)


_MENTIONS = f"{D.NAMES}, ment AS (SELECT f.bank_id, f.name, n.created_at AS seen FROM named f JOIN memory_nodes n ON n.bank_id = f.bank_id AND n.document_id = f.document_id AND n.fact_index = f.fact_index)"


def _mentions(t: Tables) -> DataFrame:
    nodes = t("memory_nodes").select("bank_id", "document_id", "fact_index", F.col("created_at").alias("at"))
    return D.fact_names(t).join(nodes, ["bank_id", "document_id", "fact_index"]).select("bank_id", "name", "at")


@query("a2_mentions", f"WITH {_MENTIONS} SELECT bank_id, name, count(*) AS mention_count, min(seen) AS first_seen, max(seen) AS last_seen FROM ment GROUP BY ALL")
def mentions(t: Tables) -> DataFrame:
    return G.mention_rollup(_mentions(t))


@query(
    "a2_mentions_merged",
    f"""WITH {_MENTIONS}, {D.ENT}, r AS (SELECT bank_id, name, 1 AS n, seen AS a, seen AS b FROM ment UNION ALL SELECT bank_id, name, mention_count, NULL, last_seen FROM ent)
SELECT bank_id, name, sum(n)::BIGINT AS mention_count, min(a) AS first_seen, max(b) AS last_seen FROM r GROUP BY ALL""",
)
def mentions_merged(t: Tables) -> DataFrame:
    return G.mention_rollup(_mentions(t), D.entities(t).withColumn("first_seen", F.lit(None).cast("long")))


_TOGETHER = f"{D.MEMBERS}, tog AS (SELECT x.entity_id AS entity_id_1, y.entity_id AS entity_id_2, count(*) AS together, max(x.seen_at) AS last_at FROM members x JOIN members y ON y.node_id = x.node_id AND x.entity_id < y.entity_id GROUP BY ALL)"


@query("a3_entity_cooccurrence", f"WITH {_TOGETHER} SELECT * FROM tog")
def entity_cooccurrence(t: Tables) -> DataFrame:
    return G.entity_cooccurrence(D.node_entities(t))


@query(
    "g6_resolution_context",
    f"""WITH {_TOGETHER}, e AS (SELECT bank_id, id, name FROM ent QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY last_seen DESC NULLS LAST, id) <= 5000),
p AS (SELECT entity_id_1 AS id, entity_id_2 AS partner, together FROM tog UNION ALL SELECT entity_id_2, entity_id_1, together FROM tog),
b AS (SELECT id, partner FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY together DESC, partner) <= 64)
SELECT e.bank_id, e.id, e.name AS canonical_name, coalesce((SELECT string_agg(partner, ',' ORDER BY partner) FROM b WHERE b.id = e.id), '') AS partners FROM e""",
)
def resolution_context(t: Tables) -> DataFrame:
    known = D.entities(t).withColumnRenamed("name", "canonical_name")
    found = G.resolution_context(known, G.entity_cooccurrence(D.node_entities(t)))
    return found.select("bank_id", "id", "canonical_name", F.array_join(F.transform("partner_ids", lambda x: x.cast("string")), ",").alias("partners"))


@query(
    "f6_view_nodes",
    f"""WITH {D.TAGS}, f AS (SELECT tag FROM tagged GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1)
SELECT bank_id, id, fact_type, CASE WHEN length(text) > 160 THEN substring(text, 1, 159) || '…' ELSE text END AS label FROM memory_nodes
WHERE fact_type IN ('world', 'experience') AND event_date BETWEEN 1735689600000 AND 1767225599999 AND id IN (SELECT node_id FROM tagged JOIN f USING (tag)) QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY id DESC) <= 500""",
)
def view_nodes(t: Tables) -> DataFrame:
    tags = D.node_tags(t)
    common = tags.groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(1)  # the feature is a request for one tag
    rows = G.view_nodes(t("memory_nodes"), ["world", "experience"], 1735689600000, 1767225599999, 500, tags.join(common, "tag", "left_semi"))
    return rows.select("bank_id", "id", "fact_type", T.label(F.col("text")).alias("label"))


@query(
    "g7_view_edges",
    """WITH n AS (SELECT id, bank_id FROM memory_nodes WHERE fact_type IN ('world', 'experience')),
u AS (SELECT a.bank_id, l.from_node_id, l.to_node_id, l.link_type, l.entity_id, max(l.weight) AS weight FROM links l JOIN n a ON a.id = l.from_node_id JOIN n b ON b.id = l.to_node_id AND b.bank_id = a.bank_id GROUP BY ALL),
s AS (SELECT bank_id, count(*) * 50 AS most FROM n GROUP BY bank_id),
r AS (SELECT u.*, row_number() OVER (PARTITION BY bank_id ORDER BY weight DESC, from_node_id, to_node_id, link_type, entity_id) AS nth FROM u)
SELECT r.* EXCLUDE (nth) FROM r JOIN s ON s.bank_id = r.bank_id WHERE nth <= most""",
)
def view_edges(t: Tables) -> DataFrame:
    return G.induced_edges(G.view_nodes(t("memory_nodes"), ["world", "experience"]), t("links"))


@query(
    "a4_neighbours",
    """WITH p AS (SELECT from_node_id AS node_id, to_node_id AS other_id, link_type, weight FROM links UNION ALL SELECT to_node_id, from_node_id, link_type, weight FROM links),
b AS (SELECT node_id, link_type, other_id, max(weight) AS weight FROM p WHERE node_id <> other_id GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY node_id, link_type ORDER BY weight DESC, other_id) AS nth FROM b QUALIFY nth <= 20""",
)
def neighbours(t: Tables) -> DataFrame:
    return G.neighbours(t("links"))


@query(
    "g8_detail",
    f"""WITH {D.MEMBERS}, {D.SOURCES}, {D.TAGS},
e AS (SELECT m.node_id, string_agg(e.name, ',' ORDER BY e.name) AS names FROM (SELECT DISTINCT node_id, entity_id FROM members) m JOIN ent e ON e.id = m.entity_id GROUP BY 1),
s AS (SELECT observation_id AS node_id, string_agg(source_id, ',' ORDER BY source_id) AS source_ids FROM (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY source_id) <= 50) GROUP BY 1),
c AS (SELECT source_id AS node_id, string_agg(observation_id, ',' ORDER BY observation_id) AS cited_by FROM (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY observation_id) <= 50) GROUP BY 1),
g AS (SELECT node_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tagged GROUP BY 1),
np AS (SELECT from_node_id AS node_id, to_node_id AS other_id, link_type, weight FROM links UNION ALL SELECT to_node_id, from_node_id, link_type, weight FROM links),
nm AS (SELECT node_id, link_type, other_id, row_number() OVER (PARTITION BY node_id, link_type ORDER BY max(weight) DESC, other_id) AS nth FROM np WHERE node_id <> other_id GROUP BY node_id, link_type, other_id QUALIFY nth <= 20),
nb AS (SELECT node_id, string_agg(link_type || ':' || other_id, ',' ORDER BY link_type, nth) AS near FROM nm GROUP BY 1)
SELECT n.id AS node_id, g.tags, e.names, s.source_ids, c.cited_by, nb.near FROM memory_nodes n LEFT JOIN g ON g.node_id = n.id LEFT JOIN e ON e.node_id = n.id LEFT JOIN s ON s.node_id = n.id LEFT JOIN c ON c.node_id = n.id LEFT JOIN nb ON nb.node_id = n.id""",
)
def detail(t: Tables) -> DataFrame:
    rows = G.node_detail(t("memory_nodes"), D.node_tags(t), D.entities(t), D.node_entities(t), D.sources(t), t("links"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    near = F.array_join(F.transform("neighbours", lambda x: F.concat_ws(":", x["link_type"], x["other_id"].cast("string"))), ",").alias("near")
    return rows.select("node_id", *[text(c) for c in ("tags", "names", "source_ids", "cited_by")], near)


@query(
    "g7_view_names",
    f"""WITH {D.MEMBERS}, n AS (SELECT id FROM memory_nodes WHERE fact_type = 'experience' QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY id DESC) <= 30)
SELECT m.node_id, string_agg(e.name, ',' ORDER BY e.name) AS names FROM (SELECT DISTINCT node_id, entity_id FROM members) m JOIN ent e ON e.id = m.entity_id WHERE m.node_id IN (SELECT id FROM n) GROUP BY 1""",
)
def view_names(t: Tables) -> DataFrame:
    view = G.view_nodes(t("memory_nodes"), ["experience"], limit=30)
    return G.names_of_nodes(view, D.entities(t), D.node_entities(t)).select("node_id", F.array_join("names", ",").alias("names"))


@query(
    "a5_anatomy",
    f"""WITH RECURSIVE {_COMP}, {D.SOURCES},
d0 AS (SELECT node_id, count(*) AS degree FROM (SELECT from_node_id AS node_id FROM ins UNION ALL SELECT to_node_id FROM ins) GROUP BY 1),
d AS (SELECT n.bank_id, n.id, coalesce(d0.degree, 0) AS degree FROM memory_nodes n LEFT JOIN d0 ON d0.node_id = n.id),
s AS (SELECT bank_id, count(*) AS nodes, min(degree) AS degree_min, max(degree) AS degree_max, round(avg(degree), 6) AS degree_mean, count(*) FILTER (degree = 0) AS isolated,
      list_sort(list(degree))[least(floor(count(*) * 0.5::DOUBLE), count(*) - 1)::BIGINT + 1] AS degree_p50, list_sort(list(degree))[least(floor(count(*) * 0.9::DOUBLE), count(*) - 1)::BIGINT + 1] AS degree_p90 FROM d GROUP BY 1),
l AS (SELECT bank_id, count(*) AS links, count(*) FILTER (ft <> tt) AS cross_type_links, {", ".join(f"count(*) FILTER (link_type = '{k}') AS {k}_links" for k in ("semantic", "temporal", "entity", "caused_by", "causes", "enables", "prevents"))} FROM ins GROUP BY 1),
v AS (SELECT o.bank_id, count(*) AS provenance_edges FROM sources s JOIN memory_nodes o ON o.id = s.observation_id GROUP BY 1),
c AS (SELECT bank_id, count(*) AS components, max(n) AS largest_component FROM (SELECT bank_id, component, count(*) AS n FROM comp GROUP BY ALL) GROUP BY 1)
SELECT s.*, coalesce(l.links, 0) AS links, coalesce(l.cross_type_links, 0) AS cross_type_links, {", ".join(f"coalesce(l.{k}_links, 0) AS {k}_links" for k in ("semantic", "temporal", "entity", "caused_by", "causes", "enables", "prevents"))}, coalesce(v.provenance_edges, 0) AS provenance_edges, c.components, c.largest_component FROM s LEFT JOIN v ON v.bank_id = s.bank_id LEFT JOIN l ON l.bank_id = s.bank_id JOIN c ON c.bank_id = s.bank_id""",
)
def anatomy(t: Tables) -> DataFrame:
    return G.anatomy(t("memory_nodes"), t("links"), D.sources(t))


@query(
    "a6_largest_components",
    f"""WITH RECURSIVE {_COMP}
SELECT bank_id, component, count(*) AS n, count(*) FILTER (fact_type = 'world') AS world, count(*) FILTER (fact_type = 'experience') AS experience, count(*) FILTER (fact_type = 'observation') AS observation,
row_number() OVER (PARTITION BY bank_id ORDER BY count(*) DESC, component) AS nth FROM comp GROUP BY bank_id, component QUALIFY nth <= 12""",
)
def largest_components(t: Tables) -> DataFrame:
    nodes = t("memory_nodes")
    place = nodes.select("id", "bank_id")
    inside = t("links").join(place.toDF("from_node_id", "bank_id"), "from_node_id").join(place.toDF("to_node_id", "to_bank"), "to_node_id").filter("bank_id = to_bank")
    return G.largest_components(nodes, inside)


@query(
    "a7_degree_quantiles",
    f"""WITH {_ULINKS}, o AS (SELECT link_type, from_node_id, count(DISTINCT to_node_id) AS degree FROM ul GROUP BY ALL)
SELECT link_type, count(*) AS n, min(degree) AS min, max(degree) AS max, round(avg(degree), 6) AS mean, list_sort(list(degree))[least(floor(count(*) * 0.5::DOUBLE), count(*) - 1)::BIGINT + 1] AS p50,
list_sort(list(degree))[least(floor(count(*) * 0.9::DOUBLE), count(*) - 1)::BIGINT + 1] AS p90 FROM o GROUP BY link_type""",
)
def degree_quantiles(t: Tables) -> DataFrame:
    out = t("links").select("link_type", "from_node_id", "to_node_id").distinct().groupBy("link_type", "from_node_id").agg(F.count(F.lit(1)).alias("degree"))
    return G.quantiles_by_rank(out, ["link_type"], "degree", {"p50": 0.5, "p90": 0.9}).withColumn("mean", F.round("mean", 6))


@query("a8_out_degrees", f"WITH {_ULINKS} SELECT from_node_id, count(DISTINCT to_node_id) AS degree FROM ul WHERE link_type = 'semantic' GROUP BY 1")
def out_degrees(t: Tables) -> DataFrame:
    return V.out_degrees(t("links"), "semantic")


@query("a9_proof_counts", f"WITH {D.SOURCES} SELECT n.id, count(s.source_id) AS proof_count FROM memory_nodes n LEFT JOIN sources s ON s.observation_id = n.id WHERE n.fact_type = 'observation' GROUP BY n.id")
def proof_counts(t: Tables) -> DataFrame:
    return C.proof_counts(t("memory_nodes").filter("fact_type = 'observation'"), D.sources(t))


@query(
    "a1_bank_stats",
    f"""WITH {_ULINKS} SELECT b.bank_id, coalesce(n.nodes, 0) AS nodes, coalesce(world, 0) AS world, coalesce(experience, 0) AS experience, coalesce(observation, 0) AS observation, coalesce(unembedded, 0) AS unembedded, coalesce(d.documents, 0) AS documents, coalesce(l.links, 0) AS links
FROM banks b LEFT JOIN (SELECT bank_id, count(*) AS nodes, count(*) FILTER (fact_type = 'world') AS world, count(*) FILTER (fact_type = 'experience') AS experience, count(*) FILTER (fact_type = 'observation') AS observation,
 count(*) FILTER (id NOT IN (SELECT node_id FROM node_vectors WHERE embedding IS NOT NULL)) AS unembedded FROM memory_nodes GROUP BY 1) n ON n.bank_id = b.bank_id
LEFT JOIN (SELECT bank_id, count(*) AS documents FROM documents GROUP BY 1) d ON d.bank_id = b.bank_id
LEFT JOIN (SELECT n.bank_id, count(*) AS links FROM ul JOIN memory_nodes n ON n.id = ul.from_node_id GROUP BY 1) l ON l.bank_id = b.bank_id""",
)
def bank_stats(t: Tables) -> DataFrame:
    return S.bank_stats(t("banks"), t("memory_nodes"), t("documents"), t("links"), t("node_vectors"))


@query("f8_backlog", "SELECT bank_id, id, row_number() OVER (PARTITION BY bank_id ORDER BY id) AS nth FROM memory_nodes WHERE id NOT IN (SELECT node_id FROM node_vectors WHERE embedding IS NOT NULL) QUALIFY nth <= 8")
def backlog(t: Tables) -> DataFrame:
    return S.backlog(t("memory_nodes"), t("node_vectors")).select("bank_id", "id", "nth")


@query("f9_page", "SELECT id, bank_id FROM memory_nodes WHERE id > 500 ORDER BY id LIMIT 200")
def page(t: Tables) -> DataFrame:
    return S.after_id(t("memory_nodes").select("id", "bank_id"), "id", 500, 200)


@query(
    "f12_patch",
    """WITH c AS (SELECT bank_id, any_value(mission) AS mission FROM (SELECT bank_id, text AS mission FROM documents WHERE source = 'runbook' QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY doc_id) = 1) GROUP BY 1)
SELECT b.bank_id, coalesce(c.mission, b.mission) AS mission, CASE WHEN c.bank_id IS NULL THEN b.disposition END AS disposition FROM banks b LEFT JOIN c ON c.bank_id = b.bank_id""",
)
def patch(t: Tables) -> DataFrame:
    new = top(t("documents").filter("source = 'runbook'"), ["bank_id"], [F.col("doc_id")], 1, "nth").select("bank_id", F.col("text").alias("mission"), F.lit(None).cast("string").alias("disposition"), F.array(F.lit("disposition")).alias("clear"))
    return S.patch(t("banks"), new, "bank_id", ["mission", "disposition"]).select("bank_id", "mission", "disposition")


@query("a22_duplicates", "SELECT lang, sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicates(t: Tables) -> DataFrame:
    return S.duplicates(t("documents"), "lang")


@query(
    "u2_health",
    """WITH s AS (SELECT b.bank_id, b.mission IS NULL AS broken, b.updated_at % 2 = 0 AS reachable, count(n.id) AS nodes, count(n.id) FILTER (n.id NOT IN (SELECT node_id FROM node_vectors WHERE embedding IS NOT NULL)) AS behind FROM banks b LEFT JOIN memory_nodes n ON n.bank_id = b.bank_id GROUP BY ALL)
SELECT bank_id, nodes, CASE WHEN broken THEN 'UNHEALTHY' WHEN behind > 30 OR NOT reachable THEN 'DEGRADED' ELSE 'HEALTHY' END AS verdict FROM s""",
)
def health(t: Tables) -> DataFrame:
    """A state a bank: one without a mission stands for a store that cannot be read, a backlog for an error of embedding."""
    stats = bank_stats(t).join(t("banks").select("bank_id", "mission", "updated_at"), "bank_id")
    return stats.select("bank_id", "nodes", S.health(F.col("mission").isNotNull(), F.col("unembedded") > 30, F.col("updated_at") % 2 == 0).alias("verdict"))


# --- entities -------------------------------------------------------------------------------------


@query("e5_resolution")
def resolution(t: Tables) -> DataFrame:
    listed = t("archive_facts").select("row_id", "bank_id", F.col("entities").alias("nearby"), F.floor(F.unix_micros(F.try_to_timestamp("mentioned_at")) / 1000).alias("at"), F.posexplode("entities").alias("nth", "name"))
    asked = listed.filter("name is not null").select(F.concat_ws("#", "row_id", "nth").alias("mention_id"), "bank_id", "name", "nearby", "at")
    return E.resolve(asked, t("entities"))


@query("e5_exact", f"""WITH m AS (SELECT row_id || '#' || (i - 1) AS mention_id, bank_id, {D._TRIM.format("e")} AS name FROM (SELECT row_id, bank_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM archive_facts) WHERE e IS NOT NULL),
k AS (SELECT bank_id, {D._TRIM.format("canonical_name")} AS name, id, last_seen FROM entities QUALIFY row_number() OVER (PARTITION BY bank_id, name ORDER BY last_seen DESC NULLS LAST, id) = 1)
SELECT m.mention_id, k.id AS entity_id FROM m JOIN k ON k.bank_id = m.bank_id AND k.name = m.name WHERE m.name <> ''""")
def exact_resolution(t: Tables) -> DataFrame:
    return resolution(t).filter("how = 'exact'").select("mention_id", "entity_id")


@query("e5_edited", f"""WITH k AS (SELECT bank_id, {D._TRIM.format("canonical_name")} AS name, id, last_seen FROM entities WHERE len(regexp_extract_all(canonical_name, '[0-9]')) = 0 QUALIFY row_number() OVER (PARTITION BY bank_id, name ORDER BY last_seen DESC NULLS LAST, id) = 1)
SELECT k.id AS mention_id, 'new' AS how FROM k WHERE name <> ''""")
def edited_resolution(t: Tables) -> DataFrame:
    """Names with digits added are other things, however alike: none resolves."""
    first = top(t("entities").filter(~F.col("canonical_name").rlike("[0-9]")).withColumn("name", E.normalise_name(F.col("canonical_name"))), ["bank_id", "name"], [F.desc_nulls_last("last_seen"), F.col("id")], 1, "_n").filter("name <> ''")
    plain = t("entities").filter(~F.col("canonical_name").rlike("[0-9]"))
    asked = first.select(F.col("id").alias("mention_id"), "bank_id", F.concat("name", F.lit("-77")).alias("name"), F.array(F.col("name")).alias("nearby"), F.col("last_seen").alias("at"))
    return E.resolve(asked, plain).select("mention_id", "how")


@query("e2_ratios", f"""WITH n AS (SELECT id, {D._TRIM.format("canonical_name")} AS name FROM entities) SELECT id, round(2.0::DOUBLE * length(name) / (2 * length(name) + 3), 6) AS longer, round(2.0::DOUBLE * (length(name) - 1) / (2 * length(name) - 1), 6) AS shorter, 2.0 * 3 >= 0.5 * (length(name) + 3) AS could FROM n WHERE length(name) BETWEEN 2 AND 190""")
def name_ratios(t: Tables) -> DataFrame:
    """A name against itself with three strange characters behind it, and without its last; both hold one block in common."""
    name = E.normalise_name(F.col("canonical_name"))
    rows = t("entities").select("id", name.alias("name")).filter("length(name) between 2 and 190")
    cut = F.expr("substring(name, 1, length(name) - 1)")
    return rows.select("id", F.round(E.name_ratio("name", F.concat("name", F.lit("§¶Ø"))), 6).alias("longer"), F.round(E.name_ratio("name", cut), 6).alias("shorter"), E.could_reach(F.col("name"), F.lit("abc")).alias("could"))


@query("e1_names", f"SELECT id, {D._TRIM.format('canonical_name')} AS name, array_to_string(regexp_extract_all(canonical_name, '[0-9]+'), ',') AS digits FROM entities WHERE canonical_name IS NOT NULL")
def names(t: Tables) -> DataFrame:
    rows = t("entities").filter("canonical_name is not null")
    return rows.select("id", E.normalise_name(F.col("canonical_name")).alias("name"), F.array_join(E.digit_runs(F.col("canonical_name")), ",").alias("digits"))


# --- curation -------------------------------------------------------------------------------------

_MARKS = "marks AS (SELECT bank_id, coalesce(max(watermark), 0) AS watermark FROM bank_reports GROUP BY 1)"
_PENDING = f"{_MARKS}, pend AS (SELECT n.* FROM memory_nodes n LEFT JOIN marks m ON m.bank_id = n.bank_id WHERE n.fact_type <> 'observation' AND n.id > coalesce(m.watermark, 0))"


@query("a10_watermarks", f"WITH {_MARKS} SELECT * FROM marks")
def watermarks(t: Tables) -> DataFrame:
    return C.watermarks(t("bank_reports"))


@query("a21_pending", f"WITH {_PENDING} SELECT bank_id, count(*) AS pending, min(id) AS first_id FROM pend GROUP BY 1")
def pending(t: Tables) -> DataFrame:
    return C.pending(t("memory_nodes"), C.watermarks(t("bank_reports"))).groupBy("bank_id").agg(F.count(F.lit(1)).alias("pending"), F.min("id").alias("first_id"))


@query("c2_batches", f"WITH {_PENDING} SELECT bank_id, id, row_number() OVER (PARTITION BY bank_id ORDER BY id) AS place, (row_number() OVER (PARTITION BY bank_id ORDER BY id) - 1) // 8 AS batch FROM pend QUALIFY place <= 50")
def batches(t: Tables) -> DataFrame:
    return C.batches(C.pending(t("memory_nodes"), C.watermarks(t("bank_reports")))).select("bank_id", "id", "place", "batch")


_CAND = f"""{D.SOURCES}, cand AS (SELECT f.bank_id AS batch_id, f.id AS fact_place, o.id AS observation_id, len(list_filter(regexp_split_to_array(o.text, '\\s+'), lambda x: x <> '')) AS tokens
 FROM sources s JOIN memory_nodes o ON o.id = s.observation_id JOIN memory_nodes f ON f.id = s.source_id),
u AS (SELECT batch_id, observation_id, tokens, min(fact_place) AS f FROM cand GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY f, observation_id) AS place, sum(tokens) OVER (PARTITION BY batch_id ORDER BY f, observation_id ROWS UNBOUNDED PRECEDING) AS total FROM u),
pooled AS (SELECT batch_id, observation_id, place FROM pl WHERE total <= 512 OR place = 1)"""


def _candidates(t: Tables) -> DataFrame:
    nodes = t("memory_nodes").select("id", "bank_id", "text")
    src = D.sources(t)
    rows = src.join(nodes.select(F.col("id").alias("observation_id"), T.count_words(F.col("text")).alias("tokens")), "observation_id").join(nodes.select(F.col("id").alias("source_id"), "bank_id"), "source_id")
    return rows.select(F.col("bank_id").alias("batch_id"), F.col("source_id").alias("fact_place"), F.lit(1).alias("rank"), "observation_id", "tokens")


@query("c3_pool", f"WITH {_CAND} SELECT * FROM pooled")
def pool(t: Tables) -> DataFrame:
    return C.pool(_candidates(t))


_KEPT = f"""WITH {_CAND}, z AS (SELECT id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM memory_nodes),
r AS (SELECT p.batch_id, p.place, p.observation_id, s.source_id AS fact_id, z.n AS tokens FROM pooled p JOIN sources s ON s.observation_id = p.observation_id JOIN z ON z.id = s.source_id),
li AS (SELECT batch_id, list({{'p': place::BIGINT, 'o': observation_id, 'f': fact_id, 't': tokens::BIGINT, 'own': 0::BIGINT, 'al': 0::BIGINT, 'stop': false, 'kept': []::BIGINT[]}} ORDER BY place, fact_id DESC) AS l FROM r GROUP BY 1),
rd AS (SELECT batch_id, list_reduce(list_prepend({{'p': -1::BIGINT, 'o': 0::BIGINT, 'f': 0::BIGINT, 't': 0::BIGINT, 'own': 0::BIGINT, 'al': 0::BIGINT, 'stop': false, 'kept': []::BIGINT[]}}, l), lambda a, x:
 CASE WHEN x.p = a.p AND a.stop THEN a
      WHEN (CASE WHEN x.p = a.p THEN a.own ELSE 0 END) + x.t <= 60 AND a.al + x.t <= 300 THEN {{'p': x.p, 'o': 0::BIGINT, 'f': 0::BIGINT, 't': 0::BIGINT, 'own': (CASE WHEN x.p = a.p THEN a.own ELSE 0 END) + x.t, 'al': a.al + x.t, 'stop': false, 'kept': list_append(a.kept, x.o * 10000000 + x.f)}}
      ELSE {{'p': x.p, 'o': 0::BIGINT, 'f': 0::BIGINT, 't': 0::BIGINT, 'own': CASE WHEN x.p = a.p THEN a.own ELSE 0 END, 'al': a.al, 'stop': true, 'kept': a.kept}} END).kept AS k FROM li)
SELECT batch_id, u // 10000000 AS observation_id, u % 10000000 AS fact_id FROM (SELECT batch_id, unnest(k) AS u FROM rd)"""


@query("c4_source_facts", _KEPT)
def source_facts(t: Tables) -> DataFrame:
    sizes = t("memory_nodes").select(F.col("id").alias("fact_id"), T.count_words(F.col("text")).alias("tokens"))
    rows = C.pool(_candidates(t)).join(D.sources(t).withColumnRenamed("source_id", "fact_id"), "observation_id").join(sizes, "fact_id")
    return C.source_facts(rows, 60, 300)


@query("c8_twins", f"""WITH {D.VECTORS}, o AS (SELECT v.* FROM vecs v JOIN memory_nodes n ON n.id = v.node_id WHERE n.fact_type = 'observation'),
k AS (SELECT q.node_id AS observation_id, v.node_id AS twin_id, round(list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(v.v, v.v)), 6) AS similarity FROM o q JOIN o v ON v.bank_id = q.bank_id AND coalesce(v.embedding_model, '') = coalesce(q.embedding_model, '') AND len(v.v) = len(q.v) AND v.node_id <> q.node_id)
SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY similarity DESC, twin_id) AS nth FROM k WHERE similarity >= 0.6 QUALIFY nth <= 5""")
def twins(t: Tables) -> DataFrame:
    return C.near_twins(D.vectors(t), t("memory_nodes").filter("fact_type = 'observation'"), 0.6)


@query("c9_merged_sources", f"WITH {D.SOURCES} SELECT DISTINCT CASE WHEN observation_id % 3 = 0 THEN observation_id - 1 ELSE observation_id END AS observation_id, source_id FROM sources")
def merged_sources(t: Tables) -> DataFrame:
    src = D.sources(t)
    merges = src.filter("observation_id % 3 = 0").select(F.col("observation_id").alias("lost_id"), (F.col("observation_id") - 1).alias("kept_id")).distinct()
    return C.merge_twins(src, merges)


@query(
    "c6_plans",
    """WITH o AS (SELECT bank_id, id, text, row_number() OVER (PARTITION BY bank_id ORDER BY id) AS n FROM memory_nodes WHERE fact_type = 'observation'), f AS (SELECT bank_id, min(id) AS fact FROM memory_nodes WHERE fact_type = 'world' GROUP BY 1)
SELECT o.bank_id AS batch_id, 'update' AS action, o.id AS observation_id, 'new ' || trim(o.text) AS text, f.fact::VARCHAR AS ids FROM o JOIN f ON f.bank_id = o.bank_id WHERE o.n = 1 AND f.fact % 4 = 0
UNION ALL SELECT f.bank_id, 'create', NULL, 'made of ' || f.fact, f.fact::VARCHAR FROM f WHERE bank_id IN (SELECT bank_id FROM o) AND f.fact % 4 IN (0, 3)
UNION ALL SELECT o.bank_id, 'delete', o.id, NULL, '' FROM o JOIN f ON f.bank_id = o.bank_id WHERE (o.n = 2 AND f.fact % 4 = 0) OR (o.n <= 2 AND f.fact % 4 = 3)""",
)
def plans(t: Tables) -> DataFrame:
    """A reply a bank, by the rest of its fact's id over 4: 0 holds, 1 updates twice, 2 deletes thrice, 3 has an update that cites what is no fact."""
    nodes = t("memory_nodes")
    obs = top(nodes.filter("fact_type = 'observation'").select("bank_id", "id", "text"), ["bank_id"], [F.col("id")], None, "n")
    facts = nodes.filter("fact_type = 'world'").groupBy("bank_id").agg(F.min("id").alias("fact"))
    one = obs.filter("n = 1").select("bank_id", F.col("id").alias("o1"), F.trim("text").alias("t1")).join(obs.filter("n = 2").select("bank_id", F.col("id").alias("o2")), "bank_id", "left").join(facts, "bank_id")
    known, partly = F.array("fact"), F.array(F.col("fact"), F.lit(-5).cast("long"))  # -5 is no fact
    because, kind = F.lit("because").alias("reason"), F.col("fact") % 4
    create = lambda text, ids, reason=because: F.struct(text.alias("text"), ids.alias("source_fact_ids"), reason)
    made = F.concat(F.lit(" made of "), F.col("fact").cast("string"), F.lit(" "))
    update = F.struct(F.col("o1").alias("observation_id"), F.concat(F.lit("new "), "t1", F.lit(" ")).alias("text"), F.when(kind == 3, partly).otherwise(known).alias("source_fact_ids"), because)
    delete = lambda c: F.struct(F.col(c).alias("observation_id"), because)
    reply = F.struct(
        F.array(create(made, known), create(made, partly), create(F.lit(" "), known), create(made, known, F.lit("").alias("reason")), create(made, F.array().cast("array<bigint>"))).alias("creates"),
        F.when(kind == 1, F.array(update, update)).otherwise(F.array(update)).alias("updates"),
        F.when(kind == 2, F.array(delete("o2"), delete("o1"), delete("o1"))).otherwise(F.array(delete("o2"), delete("o1"))).alias("deletes"),
    )
    replies = one.select(F.col("bank_id").alias("batch_id"), F.to_json(reply).alias("reply"))
    actions = C.validate_plans(replies, obs.select(F.col("bank_id").alias("batch_id"), F.col("id").alias("observation_id")), facts.select(F.col("bank_id").alias("batch_id"), F.col("fact").alias("fact_id")))
    return actions.select("batch_id", "action", "observation_id", "text", F.array_join(F.transform("source_fact_ids", lambda x: x.cast("string")), ",").alias("ids"))


# --- mental models --------------------------------------------------------------------------------

_MODELS = """md AS (SELECT model_id, bank_id, last_value(content IGNORE NULLS) OVER w AS content, last_refreshed_at, refresh_watermark, written_at, row_number() OVER (PARTITION BY model_id ORDER BY written_at DESC, refresh_id DESC) AS rn FROM mental_refreshes
 WINDOW w AS (PARTITION BY model_id ORDER BY written_at, refresh_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), models AS (SELECT * EXCLUDE (rn) FROM md WHERE rn = 1)"""


@query("m1_models", f"WITH {_MODELS} SELECT model_id, bank_id, content, last_refreshed_at, row_number() OVER (PARTITION BY bank_id ORDER BY last_refreshed_at DESC NULLS LAST, written_at DESC, model_id) AS place FROM models QUALIFY place <= 50")
def models(t: Tables) -> DataFrame:
    return C.list_models(C.latest_models(t("mental_refreshes"))).select("model_id", "bank_id", "content", "last_refreshed_at", "place")


@query(
    "m3_refresh_inputs",
    f"""WITH {_MODELS}, q AS (SELECT model_id, bank_id, coalesce(refresh_watermark, -1) AS mark FROM models)
SELECT q.model_id, q.bank_id, count(n.id) AS facts, coalesce(max(n.created_at), nullif(q.mark, -1)) AS new_watermark FROM q LEFT JOIN memory_nodes n ON n.bank_id = q.bank_id AND n.created_at > q.mark GROUP BY q.model_id, q.bank_id, q.mark""",
)
def refresh_inputs(t: Tables) -> DataFrame:
    return C.refresh_inputs(C.latest_models(t("mental_refreshes")), t("memory_nodes"))


@query(
    "m8_outcomes",
    """SELECT refresh_id, CASE WHEN (audit::JSON ->> '$.facts')::BIGINT = 0 THEN 'no_facts' WHEN trim(coalesce(content, '')) = '' THEN 'empty_candidate' ELSE 'updated' END AS outcome,
NOT (coalesce((audit::JSON ->> '$.facts')::BIGINT = 0, false) OR trim(coalesce(content, '')) = '') AS replaces FROM mental_refreshes""",
)
def outcomes(t: Tables) -> DataFrame:
    facts = F.get_json_object("audit", "$.facts").cast("long")
    rows = t("mental_refreshes").select("refresh_id", C.refresh_outcome(facts, F.col("content"), F.lit(False)).alias("o"))
    return rows.select("refresh_id", "o.outcome", "o.replaces")


@query(
    "m2_due",
    f"""WITH {_MODELS}, f AS (SELECT model_id, coalesce(last_refreshed_at, 0) % 5 AS k, last_refreshed_at AS seen FROM models), p AS (SELECT *, epoch_ms(CASE k WHEN 0 THEN TIMESTAMP '2026-06-30 03:00:00' WHEN 1 THEN TIMESTAMP '2026-06-30 18:45:00' WHEN 2 THEN TIMESTAMP '2026-06-29 06:30:00' WHEN 3 THEN TIMESTAMP '2024-02-29 00:00:00' END) AS fired FROM f)
SELECT model_id, coalesce(k < 4 AND (seen IS NULL OR fired > seen), false) AS due FROM p""",
)
def due(t: Tables) -> DataFrame:
    models = C.latest_models(t("mental_refreshes"))
    schedule = F.element_at(F.array(*[F.lit(s) for s in ("0 3 * * *", "*/15 8-18 * * 1-5", "30 6 1,15 * 1", "0 0 29 2 *", "bad")]), (F.coalesce("last_refreshed_at", F.lit(0)) % 5 + 1).cast("int"))
    return models.select("model_id", cron.is_due(schedule, F.col("last_refreshed_at"), NOW_MS).alias("due"))


# --- verification ---------------------------------------------------------------------------------


@query(
    "v1_violations",
    """WITH n AS (SELECT DISTINCT document_id, fact_index, unnest(causal_relations).target_fact_index AS target FROM archive_facts)
SELECT DISTINCT 'empty_text' AS rule, document_id, fact_index FROM archive_facts WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT DISTINCT 'unknown_type', document_id, fact_index FROM archive_facts WHERE NOT coalesce(fact_type IN ('world', 'experience', 'observation'), false)
UNION ALL SELECT DISTINCT 'no_date', document_id, fact_index FROM archive_facts WHERE mentioned_at IS NULL AND occurred_start IS NULL AND event_date IS NULL
UNION ALL SELECT DISTINCT 'causes_itself', document_id, fact_index FROM n WHERE target = fact_index
UNION ALL SELECT DISTINCT 'cause_out_of_range', document_id, fact_index FROM n WHERE NOT EXISTS (SELECT 1 FROM archive_facts a WHERE a.document_id = n.document_id AND a.fact_index = n.target)""",
)
def violations(t: Tables) -> DataFrame:
    return V.archive_violations(t("archive_facts"))


@query(
    "v4_sample",
    """WITH s AS (SELECT bank_id, greatest(1, floor(500 * count(*) / (SELECT count(*) FROM memory_nodes)::DOUBLE + 0.5::DOUBLE)) AS quota FROM memory_nodes GROUP BY 1)
SELECT m.bank_id, m.id FROM memory_nodes m JOIN s ON s.bank_id = m.bank_id QUALIFY row_number() OVER (PARTITION BY m.bank_id ORDER BY md5('7:' || m.id), m.id) <= any_value(s.quota) OVER (PARTITION BY m.bank_id)""",
)
def sample(t: Tables) -> DataFrame:
    return V.stratified_sample(t("memory_nodes").select("bank_id", "id"), "bank_id", "id", 500, 7)


@query(
    "v5_link_differences",
    """WITH a AS (SELECT DISTINCT from_node_id, to_node_id FROM links WHERE link_type = 'caused_by'), r AS (SELECT DISTINCT document_id, fact_index, unnest(causal_relations).target_fact_index AS target FROM archive_facts),
b AS (SELECT DISTINCT x.id AS from_node_id, y.id AS to_node_id FROM r JOIN memory_nodes x ON x.document_id = r.document_id AND x.fact_index = r.fact_index JOIN memory_nodes y ON y.document_id = r.document_id AND y.fact_index = r.target WHERE r.target <> r.fact_index AND x.id <> y.id)
SELECT *, 'extra' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'missing' FROM (FROM b EXCEPT FROM a)""",
)
def link_differences(t: Tables) -> DataFrame:
    stored = t("links").filter("link_type = 'caused_by'")
    return V.link_differences(stored, G.causal_links(t("archive_facts"), t("memory_nodes").filter("document_id is not null")))


@query(
    "v5_temporal_differences",
    f"""WITH n AS (SELECT DISTINCT id, bank_id, fact_type, event_date FROM memory_nodes WHERE archive_id IS NOT NULL),
a AS (SELECT DISTINCT from_node_id, to_node_id FROM links WHERE link_type = 'temporal' AND from_node_id IN (SELECT id FROM n) AND to_node_id IN (SELECT id FROM n)),
p AS (SELECT x.id AS from_node_id, y.id AS to_node_id, greatest(0.3::DOUBLE, 1 - abs(x.event_date - y.event_date) / {D.DAY_MS}.0::DOUBLE) AS w FROM n x JOIN n y ON y.bank_id = x.bank_id AND y.fact_type = x.fact_type AND y.id <> x.id
      AND y.event_date BETWEEN x.event_date - {D.DAY_MS} AND x.event_date + {D.DAY_MS}),
b AS (SELECT from_node_id, to_node_id FROM p QUALIFY row_number() OVER (PARTITION BY from_node_id ORDER BY w DESC, to_node_id) <= 20)
SELECT *, 'extra' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'missing' FROM (FROM b EXCEPT FROM a)""",
)
def temporal_differences(t: Tables) -> DataFrame:
    return V.temporal_differences(t("memory_nodes"), t("links"))


@query(
    "j12_ordinal_join",
    """WITH a AS (SELECT document_id, fact_index, row_id, row_number() OVER (PARTITION BY document_id, fact_index ORDER BY row_id) AS nth FROM archive_facts), b AS (SELECT document_id, fact_index, id, row_number() OVER (PARTITION BY document_id, fact_index ORDER BY id) AS nth FROM memory_nodes WHERE document_id IS NOT NULL)
SELECT a.row_id, b.id, a.nth FROM a JOIN b ON b.document_id = a.document_id AND b.fact_index = a.fact_index AND b.nth = a.nth""",
)
def ordinal_join(t: Tables) -> DataFrame:
    key = ["document_id", "fact_index"]
    a = V.nth_copies(t("archive_facts").select(*key, "row_id"), key, "row_id")
    b = V.nth_copies(t("memory_nodes").filter("document_id is not null").select(*key, "id"), key, "id")
    return a.join(b, [*key, "nth"]).select("row_id", "id", "nth")
