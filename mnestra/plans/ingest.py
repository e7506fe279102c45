"""Queries of ingest, metrics, evaluation, time expressions, sources and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.functions import text as T
from mnestra.functions import timex
from mnestra.operators import ingest as I
from mnestra.operators import metrics as M
from mnestra.operators import store as S
from mnestra.plans import tables as D
from mnestra.plans.tables import NOW_MS, Registry, Tables
from mnestra.sources import files
from mnestra.streaming import sessions as ST

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_TURNS = r"""blocks AS (SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS turn FROM (SELECT doc_id, regexp_extract_all(text, '(?s)\[role: \w+\]\n.*?\n\[\w+:end\]') AS b FROM documents WHERE text IS NOT NULL)),
turns AS (SELECT doc_id, turn, regexp_extract(block, '^\[role: (\w+)\]', 1) AS role, regexp_extract(block, '(?s)^\[role: \w+\]\n(.*)\n\[\w+:end\]$', 1) AS content FROM blocks)"""


@query("i2_turns", f"WITH {_TURNS} SELECT doc_id, turn, role, content FROM turns")
def turns(t: Tables) -> DataFrame:
    return I.split_turns(t("documents"))


def _entries(t: Tables) -> DataFrame:
    """Lines of session logs made of facts: a text, a call of one of four tools with a long input, and its result.

    The session is the document; a fact's line is the assistant's, except that every fifth is the user's.
    """
    f = t("archive_facts").groupBy("document_id", "fact_index").agg(F.min("text").alias("text"), F.min("row_id").alias("row_id"))
    k = F.col("row_id")
    name = F.element_at(F.array(*map(F.lit, ("Edit", "mcp__files__Write", "mcp__store__recall_all", "Read"))), (k % 4 + 1).cast("int"))
    given = F.struct(F.concat(F.lit("/w/src/f"), (k % 3).cast("string"), F.lit(".py")).alias("file_path"), F.repeat("text", 3).alias("content"))
    block = lambda kind, **more: F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(c) for c, v in more.items()]))
    blocks = F.concat_ws(",", block("text", text=F.col("text")), block("tool_use", name=name, input=given), block("tool_result", tool_use_id=F.lit("u"), content=F.repeat("text", 20)))
    role = F.when(k % 5 == 0, "user").otherwise("assistant")
    line = F.concat(F.lit('{"type":"'), role, F.lit('","message":{"role":"'), role, F.lit('","content":['), blocks, F.lit("]}}"))
    return f.select(F.col("document_id").alias("session_id"), F.col("fact_index").alias("turn"), line.alias("value"))


_ENTRIES = """en AS (SELECT document_id AS session_id, fact_index AS turn, min(text) AS text, min(row_id) AS k FROM archive_facts GROUP BY 1, 2),
bl AS (SELECT session_id, turn, 0 AS nth, 'text' AS type, NULL AS name, NULL AS input, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content, k FROM en
 UNION ALL SELECT session_id, turn, 1, 'tool_use', ['Edit', 'mcp__files__Write', 'mcp__store__recall_all', 'Read'][k % 4 + 1], CASE WHEN length(text) > 100 THEN substring(repeat(text, 3), 1, 300) || '... (+' || (3 * length(text) - 300) || ' chars)' ELSE repeat(text, 3) END, NULL, k FROM en WHERE k % 5 <> 0 AND k % 4 <> 2
 UNION ALL SELECT session_id, turn, 2, 'tool_result', NULL, NULL, CASE WHEN length(r) > 2000 THEN substring(r, 1, 2000) || '... (truncated)' ELSE r END, k FROM (SELECT *, regexp_replace(repeat(text, 20), '^\\s+|\\s+$', '', 'g') AS r FROM en))"""


@query("i3_message_blocks", f"WITH {_ENTRIES} SELECT session_id, turn, row_number() OVER (PARTITION BY session_id, turn ORDER BY nth) - 1 AS place, type, name, input, content FROM bl")
def blocks(t: Tables) -> DataFrame:
    found = I.message_blocks(_entries(t))
    kinds = "struct<content:array<struct<type:string,text:string,name:string,input:struct<file_path:string,content:string>,content:string>>>"
    rows = found.select("session_id", "turn", F.posexplode(F.from_json("blocks", kinds)["content"]).alias("place", "b"))
    return rows.select("session_id", "turn", "place", "b.type", "b.name", F.col("b.input.content").alias("input"), F.coalesce("b.content", "b.text").alias("content"))


@query(
    "i6_touched_files",
    f"WITH {_ENTRIES}, c AS (SELECT session_id, 'src/f' || (k % 3) || '.py' AS file, min(turn) AS first FROM en WHERE k % 5 <> 0 AND k % 4 IN (0, 1) GROUP BY ALL) SELECT session_id, string_agg(file, ',' ORDER BY first) AS files FROM c GROUP BY 1",
)
def files_touched(t: Tables) -> DataFrame:
    found = I.message_blocks(_entries(t))
    calls = found.select("session_id", "turn", "role", F.explode("calls").alias("c")).select("session_id", "turn", "role", "c.*", F.lit("/w").alias("cwd"))
    return I.touched_files(calls).select("session_id", F.array_join("files", ",").alias("files"))


@query(
    "i8_sessions",
    f"""WITH {_ENTRIES}, c AS (SELECT session_id, 'src/f' || (k % 3) || '.py' AS file FROM en WHERE k % 5 <> 0 AND k % 4 IN (0, 1)) SELECT e.session_id, count(*) AS messages, coalesce((SELECT count(DISTINCT file) FROM c WHERE c.session_id = e.session_id), 0) AS files, bool_or(length(text) > 100) AS saved FROM en e GROUP BY 1""",
)
def planned_sessions(t: Tables) -> DataFrame:
    plan = I.plan_sessions(_entries(t), "/w")
    return plan.select("session_id", "messages", F.coalesce(F.size("files"), F.lit(0)).alias("files"), (F.col("saved_ratio") > 0).alias("saved"))


@query(
    "a14_message_savings",
    rf"""WITH {_ENTRIES}, w AS (SELECT session_id, turn, {_WORDS.format("repeat(text, 20)")} AS raw, {_WORDS.format("CASE WHEN length(text) > 100 THEN substring(repeat(text, 20), 1, 2000) || '... (truncated)' ELSE repeat(text, 20) END")} AS capped FROM en)
SELECT session_id, turn, greatest(raw - capped, 0) AS saved, round(CASE WHEN raw = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - capped / raw::DOUBLE) END, 6) AS ratio FROM w""",
)
def message_savings(t: Tables) -> DataFrame:
    """What capping saves of the result of each call."""
    kinds = "struct<content:array<struct<type:string,content:string>>>"
    result = lambda c: F.filter(F.from_json(c, kinds)["content"], lambda b: b["type"] == "tool_result")[0]["content"]
    rows = I.message_blocks(_entries(t)).select("session_id", "turn", T.count_words(result("raw_blocks")).alias("raw"), T.count_words(result("blocks")).alias("capped"))
    return rows.select("session_id", "turn", M.tokens_saved(F.col("raw"), F.col("capped")).alias("saved"), F.round(M.saving_of_message(F.col("raw"), F.col("capped")), 6).alias("ratio"))


@query(
    "i2_transcripts",
    rf"""WITH {_TURNS}, k AS (SELECT doc_id, turn, role, trim(content) AS body FROM turns WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) <= 300)
SELECT doc_id AS session_id, string_agg('[role: ' || role || ']' || chr(10) || body || chr(10) || '[' || role || ':end]', chr(10) || chr(10) ORDER BY turn) AS transcript, count(*) AS messages FROM k WHERE body <> '' GROUP BY 1""",
)
def transcripts(t: Tables) -> DataFrame:
    said = I.split_turns(t("documents")).withColumnRenamed("doc_id", "session_id").filter(F.col("role").isin("user", "assistant"))
    return I.transcript_text(I.last_messages(said))


_PLAN = rf"""plan AS (SELECT doc_id, bank_id, {_WORDS.format("coalesce(text, '')")} AS raw_tokens, {_WORDS.format("coalesce(CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '... (truncated)' ELSE text END, '')")} AS capped_tokens, sha256(coalesce(text, '')) AS content_hash FROM documents),
planned AS (SELECT *, CASE WHEN raw_tokens > 0 AND capped_tokens > 0 THEN round(1 - least(capped_tokens, raw_tokens) / raw_tokens::DOUBLE, 6) END AS saved_ratio, row_number() OVER (PARTITION BY bank_id, content_hash ORDER BY doc_id) AS nth_copy FROM plan)"""


@query("i8_ingest_plan", f"WITH {_PLAN} SELECT doc_id, bank_id, raw_tokens, capped_tokens, saved_ratio, content_hash, nth_copy FROM planned")
def ingest_plan(t: Tables) -> DataFrame:
    return I.plan_ingest(t("documents"))


@query("i18_outcomes", f"WITH {_PLAN} SELECT doc_id, CASE WHEN raw_tokens < 2 THEN 'skipped' WHEN nth_copy > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM planned")
def outcomes(t: Tables) -> DataFrame:
    return I.outcome(I.plan_ingest(t("documents"))).select("doc_id", "outcome")


@query("a13_ratios", f"WITH {_PLAN} SELECT bank_id, sum(raw_tokens)::BIGINT AS raw, sum(capped_tokens)::BIGINT AS capped, CASE WHEN sum(raw_tokens) > 0 AND sum(capped_tokens) > 0 THEN round(1 - sum(capped_tokens) / sum(raw_tokens)::DOUBLE, 6) END AS ratio FROM planned GROUP BY 1")
def saving_ratios(t: Tables) -> DataFrame:
    sums = I.plan_ingest(t("documents")).groupBy("bank_id").agg(F.sum("raw_tokens").alias("raw"), F.sum("capped_tokens").alias("capped"))
    return sums.select("bank_id", "raw", "capped", F.round(M.saving(F.col("raw"), F.col("capped")), 6).alias("ratio"))


@query("a13_savings", f"WITH {_PLAN} SELECT bank_id, doc_id, 'retain_cap_saving' AS kind, '{{\"raw_tokens\":' || raw_tokens || ',\"capped_tokens\":' || capped_tokens || '}}' AS detail FROM planned WHERE raw_tokens > capped_tokens")
def savings(t: Tables) -> DataFrame:
    return I.savings_ledger(I.plan_ingest(t("documents")))


@query("i9_rejoined", r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS chars, true AS fits, length(text) <= 3000 AS whole FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\S')")
def rejoined(t: Tables) -> DataFrame:
    """Chunks hold all that is not blank, none is over 3,000 characters, and a text that fits is one chunk."""
    rows = I.chunks(t("documents")).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("chunk", r"\s+", ""))).alias("chars"), (F.max(F.length("chunk")) <= 3000).alias("fits"), (F.count(F.lit(1)) == 1).alias("whole"))
    return rows.filter("chars > 0")


@query("i9_chunks")
def chunks(t: Tables) -> DataFrame:
    return I.chunks(t("documents"))


@query("i7_stripped", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '(?s)<memories>.*?</memories>', '', 'g'), '(?s)<relevant_memories>.*?</relevant_memories>', '', 'g')) AS chars FROM documents WHERE text IS NOT NULL")
def stripped(t: Tables) -> DataFrame:
    return t("documents").filter("text is not null").select("doc_id", F.length(T.strip_blocks(F.col("text"), list(I.MEMORY_TAGS))).alias("chars"))


def _replies(t: Tables) -> DataFrame:
    """Replies of a model, made of the facts of a document: a junk fact first, so that positions move."""
    rows = t("archive_facts").groupBy("document_id", "fact_index").agg(F.min("text").alias("text"), F.min("fact_type").alias("fact_type"))
    fact = F.struct(F.col("text").alias("what"), F.lit("N/A").alias("when"), F.lit("the team").alias("who"), F.when(F.col("fact_type") == "experience", "assistant").otherwise("world").alias("fact_type"), F.lit("event").alias("fact_kind"), F.array(F.struct(F.lit(0).alias("target_index"), F.lit("caused_by").alias("relation_type")), F.struct(F.lit(1).alias("target_index"), F.lit("caused_by").alias("relation_type"))).alias("causal_relations"))
    listed = rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_index", fact.alias("f")))), lambda x: x["f"]).alias("facts"))
    junk = F.array(F.struct(F.lit("...").alias("what"), F.lit("").alias("when"), F.lit(None).cast("string").alias("who"), F.lit("world").alias("fact_type"), F.lit("other").alias("fact_kind"), F.array().cast("array<struct<target_index:int,relation_type:string>>").alias("causal_relations")))
    return listed.select(F.col("document_id").alias("reply_id"), F.to_json(F.struct(F.concat(junk, "facts").alias("facts"))).alias("reply"), F.lit(NOW_MS).alias("event_ms"))


@query(
    "i10_facts",
    """WITH f AS (SELECT document_id, fact_index, min(text) AS text, min(fact_type) AS fact_type FROM archive_facts GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY fact_index) - 1 AS i FROM f)
SELECT document_id AS reply_id, i AS fact_index, text || ' | Involving: the team' AS text, CASE WHEN fact_type = 'experience' THEN 'experience' ELSE 'world' END AS fact_type, 'event' AS fact_kind, (CASE WHEN i >= 1 THEN 1 ELSE 0 END)::BIGINT AS causes FROM p""",
)
def facts(t: Tables) -> DataFrame:
    return I.parse_facts(_replies(t)).select("reply_id", "fact_index", "text", "fact_type", "fact_kind", F.size("causes").alias("causes"))


@query(
    "i12_falsy",
    """WITH f AS (SELECT id, text, id % 6 AS k FROM memory_nodes) SELECT id AS reply_id, CASE k WHEN 0 THEN text ELSE 'core' END || CASE WHEN k = 4 THEN ' | Involving: me' ELSE '' END AS text FROM f""",
)
def falsy(t: Tables) -> DataFrame:
    """What a fact says is a text, a number, null, an empty string, "n/A" or a list; all but the first give way to its core."""
    k = F.col("id") % 6
    what = F.when(k == 0, F.to_json(F.struct(F.col("text").alias("what")))).when(k == 1, '{"what":42}').when(k == 2, '{"what":null}').when(k == 3, '{"what":""}').when(k == 4, '{"what":"n/A"}').otherwise('{"what":["x"]}')
    rest = F.concat(F.lit(',"factual_core":"core","when":"N/A","who":'), F.when(k == 4, '"me"').otherwise("0"), F.lit("}"))
    reply = F.concat(F.lit("["), F.regexp_replace(what, r"\}$", ""), rest, F.lit("]"))
    return I.parse_facts(t("memory_nodes").select(F.col("id").alias("reply_id"), reply.alias("reply"), F.lit(NOW_MS).alias("event_ms"))).select("reply_id", "text")


@query("i11_degenerate", "SELECT doc_id FROM documents WHERE text IS NULL OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' OR regexp_full_match(text, '[.,;:!?\\-–—…\"''`´ \\t\\n\\r]*') OR text IN ('•', '·', '*', '**', '***', '_,_', '_, _, _')")
def degenerate(t: Tables) -> DataFrame:
    return t("documents").filter(T.degenerate(F.col("text"))).select("doc_id")


@query(
    "i13_augmented",
    """WITH f AS (SELECT document_id, fact_index, list_filter(entities, lambda x: x IS NOT NULL) AS e FROM archive_facts QUALIFY row_number() OVER (PARTITION BY document_id, fact_index ORDER BY row_id) = 1),
n AS (SELECT id, text, strftime(make_timestamp(occurred_start * 1000), '%B %Y') AS s, strftime(make_timestamp(occurred_end * 1000), '%B %Y') AS e, f.e AS names FROM memory_nodes m LEFT JOIN f ON f.document_id = m.document_id AND f.fact_index = m.fact_index)
SELECT id, text || CASE WHEN s IS NULL THEN '' WHEN e IS NULL OR s = e THEN ' (happened in ' || s || ')' ELSE ' (happened from ' || s || ' to ' || e || ')' END || CASE WHEN len(names) > 0 THEN ' [' || array_to_string(names, ', ') || ']' ELSE '' END AS augmented FROM n""",
)
def augmented(t: Tables) -> DataFrame:
    from mnestra.operators.retrieval import top

    first = top(t("archive_facts"), ["document_id", "fact_index"], [F.col("row_id")], 1, "_n").select("document_id", "fact_index", F.filter("entities", lambda x: x.isNotNull()).alias("names"))
    rows = t("memory_nodes").join(first, ["document_id", "fact_index"], "left")
    return rows.select("id", I.augmented(F.col("text"), F.col("occurred_start"), F.col("occurred_end"), F.col("names")).alias("augmented"))


@query("i14_normalised", f"WITH {D.VECTORS} SELECT node_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total, len(v) AS dim FROM vecs")
def normalised(t: Tables) -> DataFrame:
    unit = D.vectors(t).select("node_id", I.l2_normalise(F.col("embedding")).alias("u"))
    return unit.select("node_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("u").alias("dim"))


@query("i15_drafts", "SELECT id, occurred_start + fact_index * 10 AS occurred_start, mentioned_at + fact_index * 10 AS mentioned_at, coalesce(occurred_start, mentioned_at) + fact_index * 10 AS event_date, '{\"document_id\":\"' || document_id || '\",\"fact_index\":' || fact_index || '}' AS metadata FROM memory_nodes WHERE document_id IS NOT NULL")
def drafts(t: Tables) -> DataFrame:
    return I.draft_nodes(t("memory_nodes").filter("document_id is not null")).select("id", "occurred_start", "mentioned_at", "event_date", "metadata")


@query(
    "i16_jobs",
    """WITH c AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN NULL ELSE l_returnflag <> 'R' END AS ok, CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END AS facts, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS aborted FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
g AS (SELECT job_id, count(*) AS chunks, count(*) FILTER (ok = false) AS failed, sum(facts)::BIGINT AS facts, count(*) FILTER (ok IS NULL) AS open, bool_or(aborted) AS aborted FROM c GROUP BY 1)
SELECT job_id, chunks, failed, facts, CASE WHEN aborted THEN 'failed' WHEN open = chunks THEN 'pending' WHEN open > 0 THEN 'running' WHEN facts >= 1 OR failed = 0 THEN 'done' ELSE 'failed' END AS status FROM g""",
)
def jobs(t: Tables) -> DataFrame:
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    ok = F.when(F.col("o_orderstatus") != "O", F.col("l_returnflag") != "R")
    return I.job_state(rows.select(F.col("o_orderkey").alias("job_id"), ok.alias("ok"), F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).otherwise(0).cast("long").alias("facts"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).alias("aborted")))


@query("i17_stale", ORACLE["i16_jobs"].replace("WHEN open = chunks THEN 'pending' WHEN open > 0 THEN 'running'", "WHEN open > 0 THEN 'failed'"))
def stale(t: Tables) -> DataFrame:
    return I.fail_stale(jobs(t))


@query("i19_missions", "SELECT d.doc_id, CASE WHEN d.session_id <> '' THEN d.session_id WHEN b.mission <> '' THEN b.mission ELSE 'profile' END AS mission FROM documents d LEFT JOIN banks b ON b.bank_id = d.bank_id")
def missions(t: Tables) -> DataFrame:
    rows = t("documents").select("doc_id", "bank_id", "session_id").join(t("banks").select("bank_id", "mission"), "bank_id", "left")
    return rows.select("doc_id", I.mission(F.col("session_id"), F.col("mission"), F.lit("profile")).alias("mission"))


@query("i20_banks", "SELECT doc_id, CASE WHEN starts_with(bank_id, 'coder::') THEN 'coding' ELSE split_part(bank_id, '::', 1) || '::' || split_part(bank_id, '::', 2) END AS bank FROM documents")  # every third is in a worktree
def banks(t: Tables) -> DataFrame:
    tree = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/.worktrees/w"), F.col("doc_id").cast("string"), F.lit("/src"))).otherwise("")
    cwd = F.concat(F.lit("/work/"), F.replace("bank_id", F.lit("::"), F.lit("/")), tree)
    return t("documents").select("doc_id", I.derive_bank(cwd, F.substring_index("bank_id", "::", 1), {"/work/coder": "coding"}).alias("bank"))


@query(
    "s9_upsert",
    """WITH r AS (SELECT bank_id, model_id AS doc_key, sha256(coalesce(content, '')) AS content_hash, written_at, row_number() OVER (PARTITION BY bank_id, model_id ORDER BY written_at, refresh_id) AS n FROM mental_refreshes),
s AS (SELECT bank_id, doc_key, content_hash, written_at FROM r WHERE n = 1), w AS (SELECT bank_id, doc_key, content_hash, written_at FROM r WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY bank_id, doc_key ORDER BY written_at DESC, content_hash DESC) = 1)
SELECT s.bank_id, s.doc_key, CASE WHEN w.doc_key IS NULL OR w.content_hash = s.content_hash THEN s.content_hash ELSE w.content_hash END AS content_hash, CASE WHEN w.doc_key IS NULL OR w.content_hash = s.content_hash THEN 'stored' ELSE 'updated' END AS change FROM s LEFT JOIN w ON w.bank_id = s.bank_id AND w.doc_key = s.doc_key""",
)
def upsert(t: Tables) -> DataFrame:
    from mnestra.operators.retrieval import top

    rows = t("mental_refreshes").select("bank_id", F.col("model_id").alias("doc_key"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), "written_at", "refresh_id")
    numbered = top(rows, ["bank_id", "doc_key"], [F.col("written_at"), F.col("refresh_id")], None, "n").drop("refresh_id")
    merged = I.merge_documents(numbered.filter("n = 1").drop("n"), numbered.filter("n > 1").drop("n"))
    return merged.select("bank_id", "doc_key", "content_hash", "change")


# --- sources --------------------------------------------------------------------------------------


@query(
    "s2_lines",
    f"""WITH {_TURNS} SELECT doc_id * 1000 + turn AS line_no, CASE WHEN role IN ('user', 'assistant') THEN 'message' ELSE 'other' END AS kind, CASE WHEN role IN ('user', 'assistant') THEN role END AS role, CASE WHEN role IN ('user', 'assistant') THEN content END AS content FROM turns""",
)
def lines(t: Tables) -> DataFrame:
    said = I.split_turns(t("documents"))
    entry = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", "content").alias("message")))
    return files.classify_lines(said.select((F.col("doc_id") * 1000 + F.col("turn")).alias("line_no"), entry.alias("value")))


@query("s1_newest_suffix", f"WITH {_TURNS} SELECT doc_id, turn FROM (SELECT *, sum(length(content)) OVER (PARTITION BY doc_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM turns) WHERE s <= 1000")
def newest_suffix(t: Tables) -> DataFrame:
    said = I.split_turns(t("documents")).withColumn("size", F.length("content"))
    return files.newest_within(said, "doc_id", "turn", "size", 1000).select("doc_id", "turn")


@query(
    "s6_corpus",
    """SELECT document_id || '#' || fact_index AS id, text, context, fact_type, array_to_string(list_sort(tags), ',') AS tags FROM archive_facts QUALIFY row_number() OVER (PARTITION BY document_id, fact_index ORDER BY row_id) = 1""",
)
def corpus(t: Tables) -> DataFrame:
    return files.export_corpus(t("archive_facts")).select("id", "text", "context", "fact_type", F.array_join("tags", ",").alias("tags"))


@query("s8_inserted", "SELECT fact_id, (SELECT max(id) FROM memory_nodes) + row_number() OVER (ORDER BY bank_id, fact_id) AS id FROM inbound_facts WHERE bank_id IS NOT NULL")
def inserted(t: Tables) -> DataFrame:
    new = t("inbound_facts").filter("bank_id is not null").select("bank_id", "fact_id")
    return files.insert_nodes(new, t("memory_nodes").select("id"), ["fact_id"]).select("fact_id", "id")


@query("s11_newest", "SELECT bank_id, refresh_id, row_number() OVER (PARTITION BY bank_id ORDER BY refresh_id DESC) AS nth FROM mental_refreshes QUALIFY nth <= 20")
def newest(t: Tables) -> DataFrame:
    return M.newest(t("mental_refreshes").select("bank_id", "refresh_id"), ["bank_id"], "refresh_id", 20)


# --- metrics --------------------------------------------------------------------------------------

_BOUNDS = "100, 500, 1000, 2000, 5000, 10000, 15000, 20000, 25000, 30000, 35000, 40000, 45000, 50000, 55000, 60000, 100000, 250000, 500000"
_HIST = f"""smp AS (SELECT event_type, CAST(floor(value * 2000) AS BIGINT) AS us FROM events WHERE value IS NOT NULL),
hist AS (SELECT event_type, coalesce(list_position(list_transform([{_BOUNDS}], lambda b: us <= b), true), 20)::BIGINT - 1 AS bucket, count(*) AS n, sum(us)::BIGINT AS total, max(us) AS most FROM smp GROUP BY ALL)"""


def _samples(t: Tables) -> DataFrame:
    return t("events").filter("value is not null").select("event_type", "event_id", F.floor(F.col("value") * 2000).cast("long").alias("us"))  # half a millisecond a unit, so that every bucket is met


@query("a11_histogram", f"WITH {_HIST} SELECT * FROM hist")
def histogram(t: Tables) -> DataFrame:
    return M.histogram(_samples(t), ["event_type"], "us")


@query(
    "a12_quantiles",
    f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS al, max(most) OVER (PARTITION BY event_type) AS top, [0, {_BOUNDS}][bucket + 1] AS low FROM hist),
h AS (SELECT *, CASE WHEN bucket < 19 THEN [0, {_BOUNDS}][bucket + 2] ELSE 18446744073709551615 END::DOUBLE AS high FROM c),
q AS (SELECT h.*, u.p, least(greatest(ceil(al * u.p), 1), al) AS target FROM h, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) u(p)),
v AS (SELECT event_type, p, round(max(least(low + (high - low) * (target - (upto - n)) / n::DOUBLE, top)) FILTER (upto - n < target AND target <= upto), 6) AS x FROM q GROUP BY ALL)
SELECT c.event_type, any_value(al)::BIGINT AS n, sum(total)::BIGINT AS total, any_value(top) AS most, (SELECT x FROM v WHERE v.event_type = c.event_type AND p = 0.5) AS p50, (SELECT x FROM v WHERE v.event_type = c.event_type AND p = 0.9) AS p90,
(SELECT x FROM v WHERE v.event_type = c.event_type AND p = 0.95) AS p95, (SELECT x FROM v WHERE v.event_type = c.event_type AND p = 0.99) AS p99 FROM c GROUP BY c.event_type""",
)
def quantiles(t: Tables) -> DataFrame:
    return M.histogram_quantiles(M.histogram(_samples(t), ["event_type"], "us"), ["event_type"])


@query("a12_under_limits", f"WITH {_HIST} SELECT event_type, count(*) FILTER (us <= 35000) AS under_35000, count(*) FILTER (us <= 60000) AS under_60000 FROM smp GROUP BY 1")
def under_limits(t: Tables) -> DataFrame:
    return M.under_limits(_samples(t), ["event_type"], "us")


@query(
    "u3_percentiles",
    f"WITH {_HIST} SELECT event_type, count(*) AS n, list_sort(list(us))[floor((count(*) - 1) * 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT + 1] AS p50, list_sort(list(us))[floor((count(*) - 1) * 0.95::DOUBLE + 0.5::DOUBLE)::BIGINT + 1] AS p95 FROM smp GROUP BY 1",
)
def percentiles(t: Tables) -> DataFrame:
    return M.sample_percentile(_samples(t), ["event_type"], "us", {"p50": 0.5, "p95": 0.95})


@query("u4_deltas", f"WITH {_HIST}, e AS (SELECT event_id // 2 AS round, event_id % 2 AS side, CAST(floor(value * 2000) AS BIGINT) AS us FROM events WHERE value IS NOT NULL) SELECT a.round, a.us - b.us AS delta FROM e a JOIN e b ON b.round = a.round AND a.side = 0 AND b.side = 1")
def deltas(t: Tables) -> DataFrame:
    rows = _samples(t).select(F.floor(F.col("event_id") / 2).alias("round"), (F.col("event_id") % 2).alias("side"), "us")
    return M.paired_deltas(rows.filter("side = 0"), rows.filter("side = 1"), ["round"], "us")


_LAB = """lab AS (SELECT DISTINCT from_node_id AS qid, to_node_id AS node_id, CASE WHEN max(weight) >= 0.8 THEN 2 WHEN max(weight) >= 0.5 THEN 1 ELSE 0 END AS grade FROM links WHERE link_type IN ('semantic', 'entity', 'caused_by') AND from_node_id <> to_node_id GROUP BY from_node_id, to_node_id),
res AS (SELECT from_node_id AS qid, to_node_id AS node_id, row_number() OVER (PARTITION BY from_node_id ORDER BY max(created_at) DESC, to_node_id) AS rank FROM links WHERE from_node_id <> to_node_id GROUP BY from_node_id, to_node_id),
rel AS (SELECT * FROM lab WHERE grade > 0), idl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, node_id) AS place FROM rel),
ib AS (SELECT qid, count(*) AS n, sum(CASE WHEN place <= 10 THEN (pow(2.0::DOUBLE, grade) - 1) / log2((place + 1)::DOUBLE) ELSE 0 END) AS best FROM idl GROUP BY 1),
ht AS (SELECT r.qid, count(*) FILTER (s.rank <= 1) AS h1, count(*) FILTER (s.rank <= 5) AS h5, count(*) AS h10, min(s.rank) AS f, sum((pow(2.0::DOUBLE, grade) - 1) / log2((s.rank + 1)::DOUBLE)) AS dcg FROM rel r JOIN res s ON s.qid = r.qid AND s.node_id = r.node_id WHERE s.rank <= 10 GROUP BY 1),
ir AS (SELECT ib.qid, round(coalesce(h1, 0) / n::DOUBLE, 6) AS recall_1, round(coalesce(h5, 0) / n::DOUBLE, 6) AS recall_5, round(coalesce(h10, 0) / n::DOUBLE, 6) AS recall_10, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(coalesce(dcg / best, 0), 6) AS ndcg_10, round(least(10, n) / n::DOUBLE, 6) AS ceiling FROM ib LEFT JOIN ht ON ht.qid = ib.qid)"""


def _ranking(t: Tables) -> DataFrame:
    from mnestra.operators.retrieval import top

    links = t("links").filter("from_node_id <> to_node_id")
    best = links.filter(F.col("link_type").isin("semantic", "entity", "caused_by")).groupBy(F.col("from_node_id").alias("qid"), F.col("to_node_id").alias("node_id")).agg(F.max("weight").alias("w"))
    labels = best.select("qid", "node_id", F.when(F.col("w") >= 0.8, 2).when(F.col("w") >= 0.5, 1).otherwise(0).alias("grade"))
    results = links.groupBy(F.col("from_node_id").alias("qid"), F.col("to_node_id").alias("node_id")).agg(F.max("created_at").alias("at"))
    return M.ranking_metrics(top(results, ["qid"], [F.desc("at"), F.col("node_id")], None), labels)


@query("a15_ranking", f"WITH {_LAB} SELECT * FROM ir")
def ranking(t: Tables) -> DataFrame:
    return _ranking(t)


@query(
    "a16_macro",
    f"""WITH {_LAB}, q AS (SELECT DISTINCT qid FROM lab), s AS (SELECT q.qid, n.fact_type AS stratum, ir.recall_10, ir.mrr, ir.qid IS NOT NULL AS there FROM q JOIN memory_nodes n ON n.id = q.qid LEFT JOIN ir ON ir.qid = q.qid),
g AS (SELECT CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, count(*) FILTER (there) AS queries, count(*) FILTER (NOT there) AS excluded, avg(recall_10) AS r, avg(mrr) AS m FROM s GROUP BY ROLLUP (stratum))
SELECT stratum, queries, excluded, round(r, 4) AS recall_10, round(m, 4) AS mrr FROM g""",
)
def macro(t: Tables) -> DataFrame:
    """Queries all of whose labels have grade 0 are excluded and counted."""
    labelled = t("links").filter("from_node_id <> to_node_id").filter(F.col("link_type").isin("semantic", "entity", "caused_by")).select(F.col("from_node_id").alias("qid")).distinct()
    strata = labelled.join(t("memory_nodes").select(F.col("id").alias("qid"), F.col("fact_type").alias("stratum")), "qid")
    means = M.macro_average(_ranking(t).select("qid", "recall_10", "mrr"), strata)
    return means.select("stratum", "queries", "excluded", F.round("recall_10", 4).alias("recall_10"), F.round("mrr", 4).alias("mrr"))


@query(
    "a20_trend",
    """WITH v AS (SELECT event_type, event_id, (props::JSON ->> '$.k')::DOUBLE AS value FROM events) SELECT event_type, event_id, value, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 6) AS scaled FROM v WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type)""",
)
def trend(t: Tables) -> DataFrame:
    return M.trend(t("events"), ["event_type"], "event_id", "props", "$.k")


# --- time, text, JSON -----------------------------------------------------------------------------


#: What is asked, and the first day and the day after the last (SQL); now is 2026-07-01, a Wednesday.
_ASKED_TIMES = (
    ("What broke yesterday?", "DATE '2026-06-30'", "DATE '2026-07-01'"),
    ("today we ship", "DATE '2026-07-01'", "DATE '2026-07-02'"),
    ("plans for tomorrow", "DATE '2026-07-02'", "DATE '2026-07-03'"),
    ("seen the day before yesterday", "DATE '2026-06-29'", "DATE '2026-06-30'"),
    ("last week in the lab", "DATE '2026-06-22'", "DATE '2026-06-29'"),
    ("THIS WEEK only", "DATE '2026-06-29'", "DATE '2026-07-06'"),
    ("next week", "DATE '2026-07-06'", "DATE '2026-07-13'"),
    ("notes of last weekend", "DATE '2026-06-27'", "DATE '2026-06-29'"),
    ("last month's bill", "DATE '2026-06-01'", "DATE '2026-07-01'"),
    ("this month", "DATE '2026-07-01'", "DATE '2026-08-01'"),
    ("next month", "DATE '2026-08-01'", "DATE '2026-09-01'"),
    ("last year", "DATE '2025-01-01'", "DATE '2026-01-01'"),
    ("this year", "DATE '2026-01-01'", "DATE '2027-01-01'"),
    ("a couple of days ago", "DATE '2026-06-28'", "DATE '2026-07-01'"),
    ("a few days ago", "DATE '2026-06-26'", "DATE '2026-06-30'"),
    ("a few weeks ago", "DATE '2026-05-27'", "DATE '2026-06-18'"),
    ("couple of months ago", "DATE '2026-04-02'", "DATE '2026-06-02'"),
    ("since last week", "DATE '2026-06-22'", "DATE '2026-07-02'"),
    ("지난주 회의", "DATE '2026-06-22'", "DATE '2026-06-29'"),
    ("지지난 달", "DATE '2026-05-01'", "DATE '2026-06-01'"),
    ("작년 여름", "DATE '2025-01-01'", "DATE '2026-01-01'"),
    ("어제부터", "DATE '2026-06-30'", "DATE '2026-07-02'"),
    ("the release of 2026-03-05.", "DATE '2026-03-05'", "DATE '2026-03-06'"),
    ("at 2026-03-05T23:30:00-05:00", "DATE '2026-03-06'", "DATE '2026-03-07'"),
    ("2024년 2월 29일에", "DATE '2024-02-29'", "DATE '2024-03-01'"),
    ("12월 25일에", "DATE '2025-12-25'", "DATE '2025-12-26'"),
    ("every Monday", None, None),
    ("before last week", None, None),
    ("since next week", None, None),
    ("작년까지", None, None),
    ("on 2026-02-30", None, None),
    ("13월 1일", None, None),
    ("yesterdayish", None, None),
    ("", None, None),
)


@query(
    "t1_windows",
    "SELECT fact_id, epoch_ms(CASE fact_id % {n} {first} END) AS first_ms, epoch_ms(CASE fact_id % {n} {last} END) - 1 AS last_ms, fact_id % {n} BETWEEN 26 AND 29 AS unbounded FROM inbound_facts".format(
        n=len(_ASKED_TIMES),
        first=" ".join(f"WHEN {i} THEN {a}::TIMESTAMP" for i, (_, a, _) in enumerate(_ASKED_TIMES) if a),
        last=" ".join(f"WHEN {i} THEN {b}::TIMESTAMP" for i, (_, _, b) in enumerate(_ASKED_TIMES) if b),
    ),
)
def windows(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x, _, _ in _ASKED_TIMES]), (F.col("fact_id") % len(_ASKED_TIMES) + 1).cast("int"))
    rows = t("inbound_facts").select("fact_id", timex.query_window(said, NOW_MS).alias("w"))
    return rows.select("fact_id", "w.first_ms", "w.last_ms", F.coalesce(F.col("w.kind") == "unconstrainable", F.lit(False)).alias("unbounded"))


@query(
    "t3_dates_in_texts",
    """WITH w AS (SELECT id, unnest(d) AS d, generate_subscripts(d, 1) AS n FROM (SELECT id, regexp_extract_all(regexp_replace(text, '\\s+', '  ', 'g'), '(?:^|\\s)[^\\p{L}\\p{N}_\\s+:-]*(\\d{4}-\\d{2}-\\d{2})[^\\p{L}\\p{N}_\\s+:-]*(?:\\s|$)', 1) AS d FROM memory_nodes WHERE NOT regexp_matches(text, '[0-9]\\s*월'))),
f AS (SELECT id, arg_min(TRY_CAST(d AS DATE), n) FILTER (TRY_CAST(d AS DATE) IS NOT NULL) AS day FROM w GROUP BY 1)
SELECT id, epoch_ms(day::TIMESTAMP) AS first_ms FROM f WHERE day IS NOT NULL""",
)
def dates_in_texts(t: Tables) -> DataFrame:
    """The first written date of texts without Korean months; none of them says a phrase of time."""
    rows = t("memory_nodes").filter(~F.col("text").rlike(r"[0-9]\s*월")).select("id", timex.query_window(F.col("text"), NOW_MS).alias("w"))
    return rows.filter("w.first_ms is not null").select("id", "w.first_ms")


_DAY_OFFSETS = (
    ("last night", -1), ("yesterday", -1), ("today", 0), ("this morning", 0), ("this afternoon", 0), ("this evening", 0), ("tonight", 0), ("tonigt", 0),
    ("tomorrow", 1), ("last week", -7), ("this week", 0), ("next week", 7), ("last month", -30), ("this month", 0), ("next month", 30),
)
_OFFSETS = " ".join(f"WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])') THEN {n}" for p, n in _DAY_OFFSETS)
_SAID = "(SELECT id, event_date, ['Last night ', 'as of today: ', 'this week ', 'tonigt ', 'next month, ', 'nothing ', 'TOMORROW ', 'lastweek '][id % 8 + 1] || text AS text FROM memory_nodes)"


@query("t6_relative_days", f"SELECT id, (event_date // {D.DAY_MS} + CASE {_OFFSETS} END) * {D.DAY_MS} AS day_ms FROM {_SAID}")
def relative_days(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Last night ", "as of today: ", "this week ", "tonigt ", "next month, ", "nothing ", "TOMORROW ", "lastweek "))), (F.col("id") % 8 + 1).cast("int"))
    return t("memory_nodes").select("id", timex.relative_day(F.concat(said, "text"), F.col("event_date")).alias("day_ms"))


@query("t7_iso", "SELECT row_id, epoch_us(occurred_start::TIMESTAMPTZ) // 1000 AS ms FROM archive_facts")
def iso(t: Tables) -> DataFrame:
    return t("archive_facts").select("row_id", timex.iso_ms(F.col("occurred_start")).alias("ms"))


@query("t8_dates", "SELECT id, strftime(make_timestamp(mentioned_at * 1000), '%Y-%m-%d %H:%M UTC') AS clock, strftime(make_timestamp(mentioned_at * 1000), '%B %Y') AS month, strftime(make_timestamp(mentioned_at * 1000), '%B %d, %Y') AS long FROM memory_nodes")
def dates(t: Tables) -> DataFrame:
    m = F.col("mentioned_at")
    return t("memory_nodes").select("id", T.clock(m).alias("clock"), T.month_and_year(m).alias("month"), T.long_date(m).alias("long"))


@query("x2_text", r"SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed, CASE WHEN length(text) > 160 THEN substring(text, 1, 159) || '…' ELSE text END AS label, regexp_replace(bank_id, '[^A-Za-z0-9._-]', '-', 'g') AS slug, url_encode(bank_id) AS encoded FROM memory_nodes")
def texts(t: Tables) -> DataFrame:
    return t("memory_nodes").select("id", T.collapse(F.col("text")).alias("collapsed"), T.label(F.col("text")).alias("label"), T.slug(F.col("bank_id")).alias("slug"), T.percent_encode(F.col("bank_id")).alias("encoded"))


@query("f14_tags", "SELECT row_id, array_to_string(list_filter(list_transform(tags, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '' AND length(x) <= 128)[1:32], ',') AS tags FROM archive_facts WHERE tags IS NOT NULL")
def clean_tags(t: Tables) -> DataFrame:
    return t("archive_facts").filter("tags is not null").select("row_id", F.array_join(T.clean_tags(F.col("tags")), ",").alias("tags"))


@query("y1_json", "SELECT id, json_valid(metadata) AS valid, metadata::JSON ->> '$.kind' AS kind FROM memory_nodes WHERE metadata IS NOT NULL")
def json_fields(t: Tables) -> DataFrame:
    return t("memory_nodes").filter("metadata is not null").select("id", S.valid_json(F.col("metadata")).alias("valid"), F.get_json_object("metadata", "$.kind").alias("kind"))


@query("s10_stamped", "SELECT id, coalesce(metadata::JSON ->> '$.kind', '-') AS kind, sha256(text) AS content_hash FROM memory_nodes")
def stamped(t: Tables) -> DataFrame:
    made = S.merge_metadata(F.col("metadata"), {"content_hash": F.sha2("text", 256)})
    rows = t("memory_nodes").select("id", made.alias("m"))
    return rows.select("id", F.coalesce(F.get_json_object("m", "$.kind"), F.lit("-")).alias("kind"), F.get_json_object("m", "$.content_hash").alias("content_hash"))


# --- sessions -------------------------------------------------------------------------------------

_EV = """ev AS (SELECT 'b' || user_id % 4 AS bank_id, user_id AS session_id, event_id AS seq, event_id AS turns, CAST(floor(value * 100) AS BIGINT) AS byte_offset, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS retains, 1 AS messages,
 CASE WHEN event_id % 3 = 0 THEN event_type END AS source, CASE WHEN event_id % 5 = 0 THEN '/w/' || event_id END AS cwd, epoch_us(ts) // 1000 AS ms FROM events)"""


def _events(t: Tables) -> DataFrame:
    e = t("events")
    return e.select(
        F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("bank_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("turns"),
        F.floor(F.col("value") * 100).cast("long").alias("byte_offset"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("retains"),
        F.lit(1).cast("long").alias("messages"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("source"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("/w/"), F.col("event_id").cast("string"))).alias("cwd"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"),
    )


@query(
    "st1_sessions",
    f"""WITH {_EV} SELECT bank_id, session_id::VARCHAR AS session_id, max(turns) AS turns, max(byte_offset) AS byte_offset, sum(retains)::BIGINT AS retains, sum(messages)::BIGINT AS messages, arg_min(source, seq) FILTER (source IS NOT NULL) AS source, arg_max(cwd, seq) FILTER (cwd IS NOT NULL) AS cwd, max(ms) AS last_seen FROM ev GROUP BY ALL""",
)
def sessions(t: Tables) -> DataFrame:
    return ST.fold_sessions(_events(t))


@query(
    "st6_catch_up",
    f"WITH {_EV}, s AS (SELECT bank_id, session_id::VARCHAR AS session_id, max(byte_offset) AS byte_offset, max(ms) AS last_seen, sum(byte_offset)::BIGINT AS file_size FROM ev GROUP BY ALL) SELECT bank_id, session_id, row_number() OVER (PARTITION BY bank_id ORDER BY last_seen DESC, session_id) AS nth FROM s WHERE file_size > byte_offset QUALIFY nth <= 3",
)
def catch_up(t: Tables) -> DataFrame:
    s = _events(t).groupBy("bank_id", "session_id").agg(F.max("byte_offset").alias("byte_offset"), F.max("at").alias("modified_at"), F.sum("byte_offset").alias("file_size"))
    return ST.catch_up(s).select("bank_id", "session_id", "nth")


@query(
    "u5_unconfirmed",
    f"WITH {_EV}, s AS (SELECT bank_id, session_id::VARCHAR AS session_id, max(byte_offset) AS byte_offset, min(byte_offset) AS confirmed, max(ms) AS last_seen FROM ev GROUP BY ALL), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY last_seen DESC, session_id) <= 10) SELECT bank_id, count(*) AS sessions, sum(greatest(byte_offset - confirmed, 0))::BIGINT AS bytes FROM k GROUP BY 1",
)
def unconfirmed(t: Tables) -> DataFrame:
    s = _events(t).groupBy("bank_id", "session_id").agg(F.max("byte_offset").alias("byte_offset"), F.min("byte_offset").alias("confirmed"), F.max("at").alias("last_seen"))
    return ST.unconfirmed_bytes(s)


@query("st7_expired", f"WITH {_EV}, s AS (SELECT bank_id, session_id::VARCHAR AS session_id, max(ms) AS last_seen FROM ev GROUP BY ALL) SELECT * FROM s WHERE last_seen < 1706590000000")
def expired(t: Tables) -> DataFrame:
    return ST.expired(_events(t).groupBy("bank_id", "session_id").agg(F.max("at").alias("last_seen")), 1706590000000)


@query("st11_ticks", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS tick_ms, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def ticks(t: Tables) -> DataFrame:
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.tick_snapshots(e, width="1 hour").select(F.floor(F.unix_micros("tick") / 1000).alias("tick_ms"), "n", F.round("total", 4).alias("total"))


@query(
    "st3_runs",
    f"WITH {_EV}, g AS (SELECT session_id, seq AS event_id, CASE WHEN ms - lag(ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS s, ms FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ms, seq)) SELECT session_id::VARCHAR AS session_id, event_id, sum(s) OVER (PARTITION BY session_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g",
)
def runs(t: Tables) -> DataFrame:
    return ST.sessionise(_events(t).withColumnRenamed("seq", "event_id"), "session_id", "at", 3_600_000).select("session_id", "event_id", "session_no")


@query("st12_feed", "SELECT bank_id, 'refreshed' AS kind, string_agg(refresh_id, ',' ORDER BY refresh_id) AS ids FROM mental_refreshes GROUP BY 1")
def feed(t: Tables) -> DataFrame:
    return ST.change_feed(t("mental_refreshes"), "refreshed", "refresh_id").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
