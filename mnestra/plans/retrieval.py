"""Queries of the retrieval arms, fusion, scoring and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.functions import text as T
from mnestra.operators import retrieval as R
from mnestra.plans import tables as D
from mnestra.plans.tables import NOW_MS, Registry, Tables
from mnestra.session import materialise

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_FOLD = f"translate(lower(text), '{T.MARKED}', '{T.PLAIN}')"
_TERMS = rf"list_filter(regexp_split_to_array({_FOLD}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_QTERMS = f"""{D.ASKED},
qt AS (SELECT qid, bank_id, term, pos FROM (SELECT qid, bank_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM asked)
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, pos) <= 12)"""
_BM25 = f"""{_QTERMS},
tok AS (SELECT id AS node_id, bank_id, fact_type, len({_TERMS}) AS dl, unnest({_TERMS}) AS word FROM memory_nodes WHERE text IS NOT NULL),
tf0 AS (SELECT node_id, bank_id, fact_type, dl, word, count(*) AS tf FROM tok GROUP BY ALL),
vocab AS (SELECT DISTINCT word FROM tf0),
pre AS (SELECT DISTINCT q.term, v.word FROM (SELECT DISTINCT term FROM qt) q JOIN vocab v ON starts_with(v.word, q.term)),
m AS (SELECT p.term, t.node_id, t.bank_id, t.dl, sum(t.tf) AS tf FROM pre p JOIN tf0 t ON t.word = p.word GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM m GROUP BY term),
st AS (SELECT count(*) AS n, avg(len({_TERMS})) AS al FROM memory_nodes WHERE text IS NOT NULL),
bm AS (SELECT qid, node_id, -round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))), 6) AS score
       FROM qt JOIN m ON m.term = qt.term AND m.bank_id = qt.bank_id JOIN dfs ON dfs.term = m.term, st GROUP BY qid, node_id),
bm25 AS (SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY score, node_id) AS rank, score FROM bm QUALIFY rank <= 100)"""
_KNN = f"""{D.VECTORS},
nn AS (SELECT q.node_id AS qid, v.node_id, round(list_dot_product(q.v, v.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(v.v, v.v)), 6) AS score
       FROM vecs q JOIN vecs v ON v.bank_id = q.bank_id AND len(v.v) = len(q.v) WHERE q.node_id % 20 = 0),
knn AS (SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank, score FROM nn WHERE qid IN (SELECT qid FROM asked) QUALIFY rank <= 100)"""
_TEMP = """temp AS (SELECT q.qid, n.id AS node_id, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(n.occurred_start, n.mentioned_at) DESC, n.id) AS rank, 0.0::DOUBLE AS score
       FROM asked q JOIN memory_nodes n ON n.bank_id = q.bank_id AND coalesce(n.occurred_start, n.mentioned_at) BETWEEN q.first_ms AND q.last_ms QUALIFY rank <= 100)"""


@query("r1_query_terms", f"WITH {_QTERMS} SELECT qid, string_agg('\"' || term || '\"*', ' OR ' ORDER BY pos) AS expression FROM qt GROUP BY qid")
def query_terms(t: Tables) -> DataFrame:
    return D.asked(t).select("qid", T.match_expression(F.col("text")).alias("expression")).filter("expression is not null")


@query("r2_bm25", f"WITH {_BM25} SELECT * FROM bm25")
def bm25(t: Tables) -> DataFrame:
    return R.bm25(D.asked(t), t("memory_nodes"), 100, index=D.index(t))


@query("r3_knn", f"WITH {D.ASKED}, {_KNN} SELECT * FROM knn")
def knn(t: Tables) -> DataFrame:
    return R.knn(D.asked(t).filter("vector is not null"), D.vectors(t), 100)


@query("r4_temporal", f"WITH {D.ASKED}, {_TEMP} SELECT qid, node_id, rank FROM temp")
def temporal(t: Tables) -> DataFrame:
    return R.temporal_arm(D.asked(t), t("memory_nodes"), 100).select("qid", "node_id", "rank")


_GRAPH = f"""WITH {D.MEMBERS},
seed AS (SELECT id AS qid, bank_id, id AS seed FROM memory_nodes WHERE id % 20 = 0),
steps AS (SELECT from_node_id AS seed, to_node_id AS node_id, link_type, weight FROM links UNION ALL SELECT to_node_id, from_node_id, link_type, weight FROM links),
st AS (SELECT s.qid, b.node_id, b.link_type, b.weight FROM seed s JOIN steps b ON b.seed = s.seed JOIN memory_nodes n ON n.id = b.node_id AND n.bank_id = s.bank_id WHERE b.node_id <> s.seed
       QUALIFY row_number() OVER (PARTITION BY s.qid ORDER BY b.weight DESC, b.node_id, b.link_type) <= 800),
linked AS (SELECT qid, node_id, max(weight) FILTER (link_type IN ('caused_by','causes','enables','prevents')) AS causal, max(weight) FILTER (link_type NOT IN ('caused_by','causes','enables','prevents')) AS other FROM st GROUP BY ALL),
sh AS (SELECT s.qid, m2.node_id, count(DISTINCT m1.entity_id) AS shared FROM seed s JOIN members m1 ON m1.node_id = s.seed JOIN ent e ON e.id = m1.entity_id AND e.mention_count <= 200
       JOIN members m2 ON m2.entity_id = m1.entity_id JOIN memory_nodes n ON n.id = m2.node_id AND n.bank_id = s.bank_id WHERE m2.node_id <> s.seed GROUP BY s.qid, m2.node_id),
sk AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY qid ORDER BY shared DESC, node_id) <= 800),
g AS (SELECT coalesce(l.qid, s.qid) AS qid, coalesce(l.node_id, s.node_id) AS node_id, round((exp(coalesce(shared, 0)::DOUBLE) - 1) / (exp(coalesce(shared, 0)::DOUBLE) + 1) + coalesce(causal, 0) + coalesce(other, 0), 6) AS score
      FROM linked l FULL JOIN sk s ON s.qid = l.qid AND s.node_id = l.node_id)
SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank, score FROM g QUALIFY rank <= 200"""


@query("r5_graph", _GRAPH)
def graph(t: Tables) -> DataFrame:
    seeds = t("memory_nodes").filter("id % 20 = 0").select(F.col("id").alias("qid"), "bank_id", F.col("id").alias("node_id"))
    return R.graph_arm(seeds, D.store(t))


_FUSE = f"""{_BM25}, {_KNN}, {_TEMP},
arms AS (SELECT *, 0 AS arm FROM knn UNION ALL SELECT qid, node_id, rank, score, 1 FROM bm25 UNION ALL SELECT qid, node_id, rank, score, 3 FROM temp),
f0 AS (SELECT qid, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(arm * 10000 + rank) AS first, max(score) FILTER (arm = 0) AS semantic, max(score) FILTER (arm = 1) AS keyword FROM arms GROUP BY ALL),
fused AS (SELECT qid, node_id, rrf, semantic, keyword, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first, node_id) AS rrf_rank FROM f0)"""


def _arms(t: Tables) -> dict[str, DataFrame]:
    asked = materialise(D.asked(t), "asked")
    nodes = t("memory_nodes")
    found = {"semantic": R.knn(asked.filter("vector is not null"), D.vectors(t), 100), "bm25": R.bm25(asked, nodes, 100, index=D.index(t)), "temporal": R.temporal_arm(asked, nodes, 100)}
    return {name: materialise(arm.select("qid", "node_id", "rank", "score"), name) for name, arm in found.items()}


@query("r6_fusion", f"WITH {_FUSE} SELECT * FROM fused")
def fusion(t: Tables) -> DataFrame:
    return R.fuse(_arms(t)).select("qid", "node_id", "rrf", "semantic", "keyword", "rrf_rank")


_SCORED = f"""c AS (SELECT f.*, n.text, n.occurred_start AS os, n.occurred_end AS oe, n.mentioned_at AS ma, n.proof_count AS pc, a.first_ms, a.last_ms,
             min(semantic) OVER w AS lo, max(semantic) OVER w AS hi, count(*) OVER w AS n_c
      FROM fused f JOIN memory_nodes n ON n.id = f.node_id JOIN asked a ON a.qid = f.qid WINDOW w AS (PARTITION BY f.qid)),
p AS (SELECT *, 1 - 0.9::DOUBLE * (rrf_rank - 1) / greatest(n_c - 1, 1) AS base,
             CASE WHEN coalesce(os, ma, oe) IS NULL THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.1::DOUBLE, 1 - ({NOW_MS} - coalesce(os, ma, oe)) / {D.DAY_MS}.0::DOUBLE / 365)) END AS rec,
             coalesce((os + oe) // 2, os, oe, ma) AS pt, (last_ms - first_ms) / 2.0::DOUBLE AS half,
             CASE WHEN pc >= 1 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + ln(pc::DOUBLE) / 10)) ELSE 0.5::DOUBLE END AS prf,
             CASE WHEN semantic IS NULL OR hi - lo <= 0 THEN 0.5::DOUBLE ELSE (semantic - lo) / (hi - lo) END AS sem FROM c),
s AS (SELECT *, CASE WHEN pt IS NULL OR first_ms IS NULL THEN 0.5::DOUBLE WHEN half > 0 THEN greatest(0.0::DOUBLE, 1 - abs(pt - (first_ms + half)) / half) ELSE 1.0::DOUBLE END AS tmp FROM p),
scored AS (SELECT *, round(base * (1 + 0.2::DOUBLE * (rec - 0.5::DOUBLE)) * (1 + 0.2::DOUBLE * (tmp - 0.5::DOUBLE)) * (1 + 0.1::DOUBLE * (prf - 0.5::DOUBLE)) * (1 + 0.1::DOUBLE * (sem - 0.5::DOUBLE)), 9) AS final FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, rrf_rank) AS final_rank FROM scored)"""
_SCORE = f"{_FUSE}, {_SCORED}"


def _ranked(t: Tables) -> DataFrame:
    columns = ["id", "fact_type", "text", "context", "occurred_start", "occurred_end", "mentioned_at", "proof_count"]
    nodes = t("memory_nodes").select(*columns).withColumnRenamed("id", "node_id")
    rows = R.fuse(_arms(t)).join(nodes, "node_id").join(D.asked(t).select("qid", "first_ms", "last_ms"), "qid").withColumn("base", F.lit(None).cast("double"))
    return materialise(R.score(rows, NOW_MS), "ranked")


@query("r14_scores", f"WITH {_SCORE} SELECT qid, node_id, final, final_rank FROM ranked")
def scores(t: Tables) -> DataFrame:
    return _ranked(t).select("qid", "node_id", "final", "final_rank")


_DEDUPED = r"""met AS (SELECT o.qid, o.node_id AS obs, o.final_rank AS own, r.node_id AS src, r.final_rank AS theirs FROM ranked o JOIN sources x ON x.observation_id = o.node_id JOIN ranked r ON r.qid = o.qid AND r.node_id = x.source_id),
best AS (SELECT qid, obs, own, min(theirs) AS b FROM met GROUP BY ALL),
gone AS (SELECT qid, obs AS node_id FROM best WHERE own > b UNION SELECT m.qid, m.src FROM met m JOIN best b ON b.qid = m.qid AND b.obs = m.obs WHERE b.own < b.b),
kept AS (SELECT * FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.qid = r.qid AND g.node_id = r.node_id)),
uniq AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM kept QUALIFY row_number() OVER (PARTITION BY qid, trim(regexp_replace(text, '\s+', ' ', 'g')) ORDER BY final_rank) = 1)"""
_DEDUP = f"""{_SCORE}, {D.SOURCES}, {_DEDUPED},
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY final_rank ROWS UNBOUNDED PRECEDING) AS total FROM uniq)"""


@query("r16_deduplicated", f"WITH {_DEDUP} SELECT qid, node_id, final_rank FROM uniq")
def deduplicated(t: Tables) -> DataFrame:
    return R.drop_same_texts(R.drop_restatements(_ranked(t), D.sources(t))).select("qid", "node_id", "final_rank")


@query("r19_budget", f"WITH {_DEDUP} SELECT qid, node_id, final_rank, total::BIGINT AS total_tokens FROM cum WHERE total <= 1024")
def budget(t: Tables) -> DataFrame:
    rows = R.drop_same_texts(R.drop_restatements(_ranked(t), D.sources(t))).withColumn("tokens", T.count_words(F.col("text")))
    return R.within_tokens(rows, 1024).select("qid", "node_id", "final_rank", "total_tokens")


def _recall_sql(types: tuple[str, ...] = ("world", "experience", "observation"), tag: bool = False, cap: int = 0, model: str | None = None, limit: int = 20, budget: int = 600, tokens: int = 1024, alpha: float = 0.1) -> str:
    """The whole recall: arms filtered after their limits, fusion, graph from the best 20, fusion again, scores, two deduplications, budgets."""
    listed = ", ".join(f"'{x}'" for x in types)
    fetch = min(max(5 * limit, 100), 1000)
    tagged = f"AND id IN (SELECT node_id FROM tagged JOIN (SELECT tag FROM tagged GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1) USING (tag))" if tag else ""
    capped = f"WHERE rank <= {cap}" if cap else ""
    producer = f"AND k.node_id IN (SELECT node_id FROM vecs WHERE embedding_model = '{model}')" if model else ""
    arm = lambda name, n: f"SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, score, {n} AS arm FROM {name} k WHERE node_id IN (SELECT id FROM fit) {producer if name == 'knn' else ''}"
    bm = _BM25.replace("JOIN dfs ON dfs.term = m.term, st", f"JOIN dfs ON dfs.term = m.term JOIN memory_nodes ty ON ty.id = m.node_id AND ty.fact_type IN ({listed}), st")
    fuse = lambda name, arms: f"{name} AS (SELECT qid, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(arm * 10000 + rank) AS first, max(score) FILTER (arm = 0) AS semantic, string_agg(DISTINCT ['semantic', 'bm25', 'graph', 'temporal'][arm + 1], ',' ORDER BY ['semantic', 'bm25', 'graph', 'temporal'][arm + 1]) AS arms FROM {arms} {capped} GROUP BY ALL)"
    return rf"""{bm.replace("rank <= 100", f"rank <= {fetch}")}, {_KNN.replace("rank <= 100", f"rank <= {fetch}")}, {_TEMP.replace("rank <= 100", f"rank <= {fetch}")}, {D.MEMBERS}, {D.TAGS}, {D.SOURCES},
fit AS (SELECT id FROM memory_nodes WHERE fact_type IN ({listed}) {tagged}),
arms3 AS ({arm("knn", 0)} UNION ALL {arm("bm25", 1)} UNION ALL {arm("temp", 3)}),
{fuse("f3", "arms3")},
seed AS (SELECT f.qid, a.bank_id, f.node_id AS seed FROM f3 f JOIN asked a ON a.qid = f.qid QUALIFY row_number() OVER (PARTITION BY f.qid ORDER BY rrf DESC, first, node_id) <= 20),
steps AS (SELECT from_node_id AS seed, to_node_id AS node_id, link_type, weight FROM links UNION ALL SELECT to_node_id, from_node_id, link_type, weight FROM links),
st8 AS (SELECT s.qid, b.node_id, b.link_type, b.weight FROM seed s JOIN steps b ON b.seed = s.seed JOIN memory_nodes n ON n.id = b.node_id AND n.bank_id = s.bank_id WHERE NOT EXISTS (SELECT 1 FROM seed z WHERE z.qid = s.qid AND z.seed = b.node_id)
       QUALIFY row_number() OVER (PARTITION BY s.qid ORDER BY b.weight DESC, b.node_id, b.link_type, s.seed) <= 800),
linked AS (SELECT qid, node_id, max(weight) FILTER (link_type IN ('caused_by','causes','enables','prevents')) AS causal, max(weight) FILTER (link_type NOT IN ('caused_by','causes','enables','prevents')) AS other FROM st8 GROUP BY ALL),
sh AS (SELECT s.qid, m2.node_id, count(DISTINCT m1.entity_id) AS shared FROM seed s JOIN members m1 ON m1.node_id = s.seed JOIN ent e ON e.id = m1.entity_id AND e.mention_count <= 200
       JOIN members m2 ON m2.entity_id = m1.entity_id JOIN memory_nodes n ON n.id = m2.node_id AND n.bank_id = s.bank_id WHERE NOT EXISTS (SELECT 1 FROM seed z WHERE z.qid = s.qid AND z.seed = m2.node_id) GROUP BY s.qid, m2.node_id),
sk AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY qid ORDER BY shared DESC, node_id) <= 800),
gr AS (SELECT coalesce(l.qid, s.qid) AS qid, coalesce(l.node_id, s.node_id) AS node_id, round((exp(coalesce(shared, 0)::DOUBLE) - 1) / (exp(coalesce(shared, 0)::DOUBLE) + 1) + coalesce(causal, 0) + coalesce(other, 0), 6) AS score
       FROM linked l FULL JOIN sk s ON s.qid = l.qid AND s.node_id = l.node_id),
graph AS (SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank, score FROM gr QUALIFY rank <= 200),
arms4 AS (SELECT * FROM arms3 UNION ALL {arm("graph", 2)}),
{fuse("f4", "arms4")},
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, first, node_id) AS rrf_rank FROM f4),
{_SCORED.replace("0.1::DOUBLE * (sem", f"{alpha}::DOUBLE * (sem")},
{_DEDUPED},
lim AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY final_rank ROWS UNBOUNDED PRECEDING) AS total FROM uniq QUALIFY row_number() OVER (PARTITION BY qid ORDER BY final_rank) <= {budget}),
answered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_rank) AS place FROM lim WHERE total <= {tokens} QUALIFY place <= {limit})"""


_ANSWER = "SELECT qid, place, node_id, final, rrf, arms, total::BIGINT AS total_tokens, text FROM answered"


def _answer(df: DataFrame) -> DataFrame:
    return df.select("qid", "place", "node_id", "final", "rrf", F.array_join("arms", ",").alias("arms"), "total_tokens", "text")


@query("r25_recall", f"WITH {_recall_sql()} {_ANSWER}")
def recall(t: Tables) -> DataFrame:
    return _answer(R.recall(D.asked(t), D.store(t), R.RecallParams(now_ms=NOW_MS)))


@query("r25_filtered", f"WITH {_recall_sql(('world', 'experience'), True, 30, 'mini-embed-v2', 8, 200, 300)} {_ANSWER}")
def recall_filtered(t: Tables) -> DataFrame:
    """Two types, one tag (strictly), the active producer of vectors only, at most 30 of each arm, low budgets."""
    tag = D.node_tags(t).groupBy("tag").count().orderBy(F.desc("count"), "tag").first()["tag"]  # the feature is a request for one tag
    params = R.RecallParams(("world", "experience"), (tag,), "all_strict", 8, 300, cap_per_source=30, budget="low", embedding_model="mini-embed-v2", now_ms=NOW_MS)
    return _answer(R.recall(D.asked(t), D.store(t), params))


@query(
    "r21_injection",
    rf"""WITH {_recall_sql()}
SELECT a.qid, '<memories>' || chr(10) || 'What is known so far:' || chr(10) || 'Current time - 2026-07-01 00:00 UTC' || chr(10) || chr(10)
 || string_agg('- ' || replace(replace(a.text, '</memories', '<' || chr(8203) || '/memories'), '<memories', '<' || chr(8203) || 'memories') || ' [' || n.fact_type || ']' || CASE WHEN n.mentioned_at IS NULL THEN '' ELSE ' (' || strftime(make_timestamp(n.mentioned_at * 1000), '%Y-%m-%d %H:%M UTC') || ')' END, chr(10) || chr(10) ORDER BY place)
 || chr(10) || '</memories>' AS injected_text FROM answered a JOIN memory_nodes n ON n.id = a.node_id GROUP BY a.qid""",
)
def injection(t: Tables) -> DataFrame:
    return R.render(R.recall(D.asked(t), D.store(t), R.RecallParams(now_ms=NOW_MS)), NOW_MS, preamble="What is known so far:")


_WHEN = "coalesce(n.occurred_start, n.mentioned_at)"


@query(
    "r22_reranked",
    f"""WITH {_FUSE},
d AS (SELECT f.qid, f.node_id, f.rrf_rank, length(concat_ws(' ', '[Date: ' || strftime(make_timestamp({_WHEN} * 1000), '%B %d, %Y') || ' (' || strftime(make_timestamp({_WHEN} * 1000), '%Y-%m-%d') || ')]', CASE WHEN n.context <> '' THEN n.context || ':' END, n.text)) % 9 - 4 AS logit FROM fused f JOIN memory_nodes n ON n.id = f.node_id)
SELECT qid, node_id, rrf_rank, round(1 / (1 + exp(-logit::DOUBLE)), 6) AS base FROM d WHERE rrf_rank <= 10""",
)
def reranked(t: Tables) -> DataFrame:
    """A scorer that looks at the length of the decorated document alone stands in for the cross-encoder."""
    nodes = t("memory_nodes").select(F.col("id").alias("node_id"), "text", "context", "occurred_start", "mentioned_at")
    rows = R.fuse(_arms(t)).join(nodes, "node_id").join(D.asked(t).select("qid", F.col("text").alias("query_text")), "qid").withColumn("base", F.lit(None).cast("double"))
    scored = R.rerank(rows, lambda q, document: (F.length(document) % 9 - 4).cast("double"))
    return scored.select("qid", "node_id", "rrf_rank", F.round("base", 6).alias("base"))


@query(
    "r24_windows",
    f"""WITH q AS (SELECT id AS qid, id % 4 AS k FROM memory_nodes)
SELECT qid, CASE k WHEN 0 THEN epoch_ms(TIMESTAMP '2026-06-30') WHEN 1 THEN epoch_ms(TIMESTAMP '2026-06-22') WHEN 2 THEN NULL ELSE epoch_ms(TIMESTAMP '2025-01-01') END AS first_ms,
CASE k WHEN 0 THEN epoch_ms(TIMESTAMP '2026-07-01') - 1 WHEN 1 THEN epoch_ms(TIMESTAMP '2026-06-29') - 1 WHEN 2 THEN NULL ELSE epoch_ms(TIMESTAMP '2026-01-01') - 1 END AS last_ms FROM q""",
)
def windows_of_queries(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("what failed yesterday?", "Last week in the lab", "every Monday", "작년에 바뀐 것"))), (F.col("id") % 4 + 1).cast("int"))
    return R.with_windows(t("memory_nodes").select(F.col("id").alias("qid"), said.alias("text")), NOW_MS).select("qid", "first_ms", "last_ms")


@query(
    "r26_rejected",
    "SELECT doc_id AS qid, CASE WHEN strlen(text) > 8192 THEN 'query too long' ELSE 'unknown bank' END AS problem FROM documents WHERE strlen(text) > 8192 OR bank_id IS NULL OR bank_id NOT IN (SELECT bank_id FROM banks WHERE mission IS NOT NULL)",
)
def rejected(t: Tables) -> DataFrame:
    return R.rejected(t("documents").select(F.col("doc_id").alias("qid"), "bank_id", "text"), t("banks").filter("mission is not null"))


@query(
    "f3_tag_modes",
    f"""WITH {D.TAGS}, w AS (SELECT node_id, list(DISTINCT tag) AS tags FROM tagged GROUP BY node_id),
n AS (SELECT m.id, coalesce(w.tags, []) AS tags FROM memory_nodes m LEFT JOIN w ON w.node_id = m.id),
q AS (SELECT tag AS a, lead(tag) OVER (ORDER BY c DESC, tag) AS b FROM (SELECT tag, count(*) AS c FROM tagged GROUP BY tag) QUALIFY row_number() OVER (ORDER BY c DESC, tag) = 1)
SELECT id, list_has_any(tags, [a, b]) OR len(tags) = 0 AS "any", list_has_all(tags, [a, b]) OR len(tags) = 0 AS "all", list_has_any(tags, [a, b]) AS any_strict, list_has_all(tags, [a, b]) AS all_strict FROM n, q""",
)
def tag_modes(t: Tables) -> DataFrame:
    tags = D.node_tags(t)
    wanted = [r["tag"] for r in tags.groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(2).collect()]  # the feature is a request with two tags
    rows = t("memory_nodes").select(F.col("id")).join(tags.groupBy(F.col("node_id").alias("id")).agg(F.collect_set("tag").alias("tags")), "id", "left")
    return rows.select("id", *[R.tag_match(F.col("tags"), wanted, m).alias(m) for m in ("any", "all", "any_strict", "all_strict")])


@query(
    "f11_hydrate",
    f"""WITH {D.TAGS}, {D.SOURCES}, w AS (SELECT node_id, list_sort(list(DISTINCT tag)) AS tags FROM tagged GROUP BY node_id), s AS (SELECT observation_id AS node_id, list_sort(list(source_id)) AS ids FROM sources GROUP BY 1)
SELECT m.id AS node_id, m.text, array_to_string(w.tags, ',') AS tags, array_to_string(s.ids, ',') AS source_ids FROM memory_nodes m LEFT JOIN w ON w.node_id = m.id LEFT JOIN s ON s.node_id = m.id""",
)
def hydrated(t: Tables) -> DataFrame:
    rows = R.hydrate(t("memory_nodes").select(F.col("id").alias("node_id")), D.store(t))
    return rows.select("node_id", "text", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("source_ids"))
