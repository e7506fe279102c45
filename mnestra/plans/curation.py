"""Queries of consolidation rounds and mental models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnestra.functions import text as T
from mnestra.operators import curation as C
from mnestra.operators import retrieval as R
from mnestra.plans import graph as P
from mnestra.plans import tables as D
from mnestra.plans.retrieval import _recall_sql
from mnestra.plans.tables import NOW_MS, Registry, Tables

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_WORDS = r"len(list_filter(regexp_split_to_array(coalesce({}, ''), '\s+'), lambda x: x <> ''))"
_BATCHES = f"{P._PENDING}, bat AS (SELECT n.bank_id || '#' || ((row_number() OVER (PARTITION BY bank_id ORDER BY id) - 1) // 8) AS batch_id, id, row_number() OVER (PARTITION BY bank_id ORDER BY id) AS place, {_WORDS.format('text')} AS tokens FROM pend n QUALIFY place <= 50)"


def _batches(t: Tables) -> DataFrame:
    facts = C.batches(C.pending(t("memory_nodes"), C.watermarks(t("bank_reports"))))
    return facts.select(F.concat_ws("#", "bank_id", "batch").alias("batch_id"), "id", "place", T.count_words(F.col("text")).alias("tokens"))


@query(
    "c2_halved",
    f"""WITH {_BATCHES}, o AS (SELECT batch_id FROM bat GROUP BY 1 HAVING sum(tokens) + 10 > 200),
h AS (SELECT bat.*, o.batch_id IS NOT NULL AS ov, count(*) OVER w AS n, row_number() OVER (PARTITION BY bat.batch_id ORDER BY place) AS nth FROM bat LEFT JOIN o ON o.batch_id = bat.batch_id WINDOW w AS (PARTITION BY bat.batch_id))
SELECT CASE WHEN ov THEN batch_id || CASE WHEN nth <= n // 2 THEN '.0' ELSE '.1' END ELSE batch_id END AS batch_id, id FROM h WHERE NOT ov OR n > 1""",
)
def halved(t: Tables) -> DataFrame:
    facts = _batches(t)
    over = facts.groupBy("batch_id").agg(F.sum("tokens").alias("n")).filter("n + 10 > 200")
    return C.halve_batches(facts, over).select("batch_id", "id")


@query("c2_fitting", f"WITH {_BATCHES} SELECT id FROM bat WHERE tokens + 10 <= 60")
def fitting(t: Tables) -> DataFrame:
    """Facts that are left when batches are halved until each is within 60 tokens: all but those that are too long alone."""
    return C.fitting_batches(_batches(t), 10, 60).select("id")


@query(
    "c5_prompts",
    f"""WITH {P._CAND}, f AS (SELECT batch_id, sum(n) + 40 AS base FROM (SELECT bank_id AS batch_id, {_WORDS.format("text")} AS n FROM memory_nodes WHERE fact_type = 'world' QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY id) <= 8) GROUP BY 1),
s AS (SELECT u.batch_id, u.observation_id, u.tokens, p.place FROM u JOIN pooled p ON p.batch_id = u.batch_id AND p.observation_id = u.observation_id),
r AS (SELECT s.batch_id, f.base + sum(tokens) OVER (PARTITION BY s.batch_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS total FROM s JOIN f ON f.batch_id = s.batch_id)
SELECT f.batch_id, f.base <= 400 AS fits, coalesce(max(r.total) FILTER (r.total <= 400), f.base)::BIGINT AS total, count(*) FILTER (r.total <= 400) AS kept FROM f LEFT JOIN r ON r.batch_id = f.batch_id GROUP BY f.batch_id, f.base""",
)
def prompts(t: Tables) -> DataFrame:
    world = R.top(t("memory_nodes").filter("fact_type = 'world'"), ["bank_id"], [F.col("id")], 8, "n")
    facts = world.select(F.col("bank_id").alias("batch_id"), T.count_words(F.col("text")).alias("tokens"))
    candidates = P._candidates(t)
    sizes = candidates.select("batch_id", "observation_id", "tokens").distinct()
    return C.assemble_prompts(facts, C.pool(candidates).join(sizes, ["batch_id", "observation_id"]), 40, 400)


@query(
    "c7_applied",
    f"""WITH acts AS ({P.ORACLE["c6_plans"]}), {D.SOURCES}, mx AS (SELECT max(id) AS m FROM memory_nodes WHERE fact_type = 'observation'),
made AS (SELECT mx.m + row_number() OVER (ORDER BY batch_id, text) AS id, batch_id AS bank_id, text, ids::BIGINT AS fact FROM acts, mx WHERE action = 'create'),
src AS (SELECT observation_id, source_id FROM sources WHERE observation_id NOT IN (SELECT observation_id FROM acts WHERE action = 'delete') UNION SELECT observation_id, ids::BIGINT FROM acts WHERE action = 'update' UNION SELECT id, fact FROM made),
o AS (SELECT n.id, n.bank_id, coalesce(u.text, n.text) AS text, u.text IS NULL OR u.text = n.text AS embedded FROM memory_nodes n LEFT JOIN acts u ON u.action = 'update' AND u.observation_id = n.id WHERE n.fact_type = 'observation' AND n.id NOT IN (SELECT observation_id FROM acts WHERE action = 'delete') UNION ALL SELECT id, bank_id, text, false FROM made)
SELECT o.id, o.bank_id, o.text, o.embedded, count(s.source_id) AS proof_count FROM o LEFT JOIN src s ON s.observation_id = o.id GROUP BY ALL""",
)
def applied(t: Tables) -> DataFrame:
    observations = t("memory_nodes").filter("fact_type = 'observation'").select("id", "bank_id", "text", F.array(F.lit(1.0)).alias("embedding"))
    actions = P.plans(t).withColumn("source_fact_ids", F.when(F.col("ids") != "", F.split("ids", ",").cast("array<bigint>")).otherwise(F.array().cast("array<bigint>")))
    rows, _ = C.apply_plans(observations, D.sources(t), actions)
    return rows.select("id", "bank_id", "text", F.col("embedding").isNotNull().alias("embedded"), "proof_count")


_TWINS = P.ORACLE["c8_twins"]
_SIZED = f"""WITH tw AS ({_TWINS}), z AS (SELECT id, bank_id, {_WORDS.format("text")} AS n FROM memory_nodes),
b AS (SELECT tw.observation_id, tw.twin_id, tw.similarity, tw.nth, a.bank_id FROM tw JOIN z a ON a.id = tw.observation_id JOIN z c ON c.id = tw.twin_id WHERE a.n + c.n + 5 <= 120),
ff AS (SELECT observation_id, twin_id, similarity, bank_id FROM b QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY nth) = 1)"""


@query("c8_first_fitting", f"{_SIZED} SELECT observation_id, twin_id, similarity FROM ff")
def first_fitting(t: Tables) -> DataFrame:
    return C.first_fitting(P.twins(t), t("memory_nodes"), 120, 5)


@query("c13_adjudicated", f"{_SIZED} SELECT bank_id, observation_id, twin_id, row_number() OVER (PARTITION BY bank_id ORDER BY observation_id) AS nth_case FROM ff QUALIFY nth_case <= 8")
def adjudicated(t: Tables) -> DataFrame:
    banks = t("memory_nodes").select(F.col("id").alias("observation_id"), "bank_id")
    return C.adjudicated(first_fitting(t).join(banks, "observation_id")).select("bank_id", "observation_id", "twin_id", "nth_case")


@query(
    "c10_decisions",
    """SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN trim(text) ELSE 'existing' END END AS kept FROM memory_nodes""",
)
def decisions(t: Tables) -> DataFrame:
    said = F.element_at(F.array(F.lit(" Merge "), F.lit("keep"), F.lit("??")), (F.col("id") % 3 + 1).cast("int"))
    reply = F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("  ")
    return t("memory_nodes").select("id", C.decision(said, reply, F.lit("existing")).alias("kept"))


_RUNS = "runs AS (SELECT row_number() OVER (ORDER BY reported_at, archive_id, facts) AS run_id, bank_id, facts, watermark, reported_at FROM bank_reports)"


@query(
    "c12_latest_runs",
    f"""WITH {_RUNS} SELECT bank_id, run_id, CASE WHEN run_id % 7 = 0 THEN 'running' WHEN run_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN run_id % 7 <> 0 THEN facts END AS facts_seen FROM runs QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY run_id DESC) = 1""",
)
def latest_runs(t: Tables) -> DataFrame:
    runs = t("bank_reports").withColumn("run_id", F.row_number().over(Window.orderBy("reported_at", "archive_id", "facts")))  # one row an archive
    finished = runs.filter("run_id % 7 <> 0").select("run_id", F.col("facts").alias("facts_seen"), F.when(F.col("run_id") % 5 == 0, "out of time").alias("error"))
    return C.latest_runs(C.finish_runs(runs.select("run_id", "bank_id"), finished)).select("bank_id", "run_id", "status", "facts_seen")


# --- mental models --------------------------------------------------------------------------------

_NUMBERED = f"{P._MODELS}, mno AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY model_id) AS n FROM models)"


def _numbered(t: Tables) -> DataFrame:
    return C.latest_models(t("mental_refreshes")).withColumn("n", F.row_number().over(Window.partitionBy("bank_id").orderBy("model_id")))


@query(
    "m1_changed",
    f"""WITH {_NUMBERED}, x AS (SELECT model_id, bank_id, model_id AS name, content, n, n % 4 AS k FROM mno)
SELECT model_id, bank_id, CASE WHEN k = 1 THEN 'renamed' ELSE name END AS name, CASE WHEN k = 2 THEN 'rewritten' ELSE content END AS content,
CASE WHEN k = 1 THEN 'none' WHEN k = 2 THEN CASE WHEN content = 'rewritten' THEN 'old' ELSE 'new' END ELSE 'old' END AS vector FROM x WHERE k <> 3
UNION ALL SELECT 'made-' || model_id, bank_id, 'made', NULL, 'none' FROM x WHERE k = 0""",
)
def changed(t: Tables) -> DataFrame:
    """Of every four models one is renamed, one rewritten with a new vector, one deleted and one left, with another created beside it."""
    rows = _numbered(t).withColumn("k", F.col("n") % 4)
    none, vector = F.lit(None).cast("string"), lambda x: F.array(F.lit(x))
    models = rows.select("model_id", "bank_id", F.col("model_id").alias("name"), "content", vector(1.0).alias("embedding"))
    action = F.when(F.col("k") == 3, "delete").otherwise("update")
    given = rows.filter("k > 0").select("model_id", action.alias("action"), none.alias("bank_id"), F.when(F.col("k") == 1, "renamed").alias("name"), F.when(F.col("k") == 2, "rewritten").alias("content"), F.when(F.col("k") == 2, vector(2.0)).alias("embedding"))
    made = rows.filter("k = 0").select(F.concat(F.lit("made-"), "model_id").alias("model_id"), F.lit("create").alias("action"), "bank_id", F.lit("made").alias("name"), none.alias("content"), F.lit(None).cast("array<double>").alias("embedding"))
    known = F.when(F.col("embedding").isNull(), "none").when(F.col("embedding")[0] == 1.0, "old").otherwise("new")
    return C.apply_model_changes(models, given.unionByName(made)).select("model_id", "bank_id", "name", "content", known.alias("vector"))


_MODEL_VECTORS = f"""{_NUMBERED}, {D.VECTORS}, vno AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY node_id) AS n FROM vecs),
mv AS (SELECT v.node_id AS model_no, m.bank_id, v.v, v.embedding_model FROM mno m JOIN vno v ON v.bank_id = m.bank_id AND v.n = m.n)"""


def _model_vectors(t: Tables) -> DataFrame:
    """The n-th model of a bank gets the n-th vector of the bank."""
    numbered = D.vectors(t).withColumn("n", F.row_number().over(Window.partitionBy("bank_id").orderBy("node_id")))
    return _numbered(t).select("bank_id", "n").join(numbered, ["bank_id", "n"]).select(F.col("node_id").alias("model_no"), "bank_id", "embedding", "embedding_model")


@query(
    "m7_nearest_models",
    f"""WITH {D.ASKED}, {_MODEL_VECTORS}, q AS (SELECT a.qid, a.bank_id, v.v FROM asked a JOIN vecs v ON v.node_id = a.qid),
k AS (SELECT q.qid, mv.model_no, mv.embedding_model, round(list_dot_product(q.v, mv.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(mv.v, mv.v)), 6) AS score FROM q JOIN mv ON mv.bank_id = q.bank_id AND len(mv.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, model_no) AS rank FROM k QUALIFY rank <= 3) SELECT qid, model_no, score, rank FROM r WHERE embedding_model = 'mini-embed-v2'""",
)
def nearest_models(t: Tables) -> DataFrame:
    return C.nearest_models(D.asked(t).filter("vector is not null"), _model_vectors(t), 3, "mini-embed-v2").select("qid", "model_no", "score", "rank")


_LATE = f"""{_recall_sql()}, {_NUMBERED.replace("sources AS", "sources_ AS")}, one AS (SELECT bank_id, model_id, refresh_watermark FROM mno WHERE n = 1),
sup AS (SELECT a.qid, a.place, a.node_id, n.created_at, {_WORDS.format("n.text")} AS tokens FROM answered a JOIN asked q ON q.qid = a.qid JOIN one ON one.bank_id = q.bank_id JOIN memory_nodes n ON n.id = a.node_id WHERE n.created_at > coalesce(one.refresh_watermark, -1))"""


def _late(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every query stands for a model with the watermark of its bank's first model."""
    found = R.recall(D.asked(t), D.store(t), R.RecallParams(now_ms=NOW_MS)).select(F.col("qid").alias("model_id"), "place", "node_id", "tokens")
    marks = _numbered(t).filter("n = 1").select("bank_id", "refresh_watermark")
    models = D.asked(t).join(marks, "bank_id").select(F.col("qid").alias("model_id"), "refresh_watermark")
    return C.supporting_facts(found, t("memory_nodes"), models)


@query("m3_supporting", f"WITH {_LATE} SELECT qid AS model_id, place, node_id, max(created_at) OVER (PARTITION BY qid) AS new_watermark FROM sup")
def supporting(t: Tables) -> DataFrame:
    facts, marks = _late(t)
    return facts.join(marks, "model_id").select("model_id", "place", "node_id", "new_watermark")


@query("f10_created_after", f"WITH {D.SOURCES} SELECT s.observation_id, s.source_id AS node_id, f.created_at FROM sources s JOIN memory_nodes o ON o.id = s.observation_id JOIN memory_nodes f ON f.id = s.source_id WHERE f.created_at > o.created_at")
def created_after(t: Tables) -> DataFrame:
    """Sources that were written after the observation that rests on them."""
    ids = D.sources(t).join(t("memory_nodes").select(F.col("id").alias("observation_id"), F.col("created_at").alias("mark")), "observation_id").withColumnRenamed("source_id", "node_id")
    return C.created_after(ids, t("memory_nodes")).select("observation_id", "node_id", "created_at")


_SHOWN = f"""{P._MODELS}, fa AS (SELECT m.model_id, n.id, {_WORDS.format("n.text")} AS tokens, row_number() OVER (PARTITION BY m.model_id ORDER BY n.created_at DESC, n.id) AS place FROM models m JOIN memory_nodes n ON n.bank_id = m.bank_id WHERE n.id % 5 = 0 QUALIFY place <= 12),
ru AS (SELECT model_id, place, sum(tokens) OVER (PARTITION BY model_id ORDER BY place ROWS UNBOUNDED PRECEDING) + 20 AS upto FROM fa)"""


def _shown(t: Tables) -> tuple[DataFrame, DataFrame]:
    models = C.latest_models(t("mental_refreshes"))
    nodes = t("memory_nodes").filter("id % 5 = 0").select("bank_id", "id", "created_at", T.count_words(F.col("text")).alias("tokens"))
    newest = R.top(nodes, ["bank_id"], [F.desc("created_at"), F.col("id")], 12, "place")
    return models.select("model_id", "bank_id").join(newest, "bank_id").select("model_id", "place", "tokens"), models


@query(
    "m4_refresh_prompts",
    f"""WITH {_SHOWN}, w AS (SELECT m.model_id, max(upto) + any_value({_WORDS.format("m.content")}) AS whole, count(*) AS n, count(*) FILTER (upto <= 250) AS c, max(upto) FILTER (upto <= 250) AS u FROM models m JOIN ru ON ru.model_id = m.model_id GROUP BY 1)
SELECT model_id, whole <= 250 AS with_content, CASE WHEN whole <= 250 THEN n ELSE c END AS kept, (CASE WHEN whole <= 250 THEN whole ELSE u END)::BIGINT AS total FROM w WHERE whole <= 250 OR c > 0""",
)
def refresh_prompts(t: Tables) -> DataFrame:
    facts, models = _shown(t)
    return C.assemble_refresh(facts, models.select("model_id", T.count_words(F.col("content")).alias("tokens")), 20, 250)


@query(
    "m5_reflection_prompts",
    f"""WITH {_SHOWN}, b AS (SELECT model_id AS qid, 1 AS turn, place, tokens FROM fa UNION ALL SELECT m.model_id, 0, g, {_WORDS.format("m.content")} // g FROM models m, range(1, 4) r(g)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY turn, place ROWS UNBOUNDED PRECEDING) + 20 AS upto FROM b)
SELECT qid, sum(turn)::BIGINT AS memories, count(*) FILTER (turn = 0) AS models, max(upto)::BIGINT AS total FROM s WHERE upto <= 250 GROUP BY 1""",
)
def reflection_prompts(t: Tables) -> DataFrame:
    facts, models = _shown(t)
    three = models.select(F.col("model_id").alias("qid"), T.count_words(F.col("content")).alias("n"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("place")).select("qid", "place", F.floor(F.col("n") / F.col("place")).alias("tokens"))
    return C.assemble_reflection(facts.withColumnRenamed("model_id", "qid"), three, 20, 250)


@query(
    "m6_citations",
    f"""WITH {D.SOURCES}, g AS (SELECT observation_id, list(source_id ORDER BY source_id) AS a FROM sources GROUP BY 1) SELECT observation_id, array_to_string(list_reverse(a), ',') AS cited FROM g""",
)
def citations(t: Tables) -> DataFrame:
    """Every source is cited twice, in falling order, among ids that were not there."""
    held = D.sources(t).groupBy("observation_id").agg(F.array_sort(F.collect_list("source_id")).alias("a"))
    said = F.flatten(F.transform(F.reverse("a"), lambda x: F.array(x, -x, x)))
    return held.select("observation_id", F.array_join(C.keep_citations(said, F.col("a")).cast("array<string>"), ",").alias("cited"))


@query(
    "u7_lines",
    """SELECT id, '{' || concat_ws(',', '"text":' || to_json(text)::VARCHAR, '"occurred_start":' || occurred_start, '"occurred_end":' || occurred_end, '"proof_count":' || proof_count) || '}' AS line FROM memory_nodes""",
)
def lines(t: Tables) -> DataFrame:
    return t("memory_nodes").select("id", C.observation_line(F.col("text"), F.col("occurred_start"), F.col("occurred_end"), F.col("proof_count")).alias("line"))
