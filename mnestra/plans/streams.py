"""Queries of sessions and of what happens at ticks, over batches of what a stream brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnestra.operators import curation as C
from mnestra.plans import tables as D
from mnestra.plans.graph import _PENDING
from mnestra.plans.ingest import _EV, _events
from mnestra.plans.tables import Registry, Tables
from mnestra.streaming import sessions as ST

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(
    "st1_ended",
    f"""WITH {_EV} SELECT bank_id, session_id::VARCHAR AS session_id, max(turns % 7) AS compactions, arg_max(cwd || '.jsonl', seq) FILTER (cwd IS NOT NULL) AS path, arg_max('clear', seq) FILTER (seq % 11 = 0) AS end_reason FROM ev GROUP BY ALL""",
)
def ended(t: Tables) -> DataFrame:
    e = _events(t).withColumns({"compactions": F.col("turns") % 7, "path": F.concat("cwd", F.lit(".jsonl")), "end_reason": F.when(F.col("seq") % 11 == 0, "clear")})
    return ST.fold_sessions(e).select("bank_id", "session_id", "compactions", "path", "end_reason")


@query(
    "st2_confirmed",
    f"""WITH {_EV}, r AS (SELECT bank_id, session_id::VARCHAR AS session_id, seq, (seq % 40) * 25 AS f, (seq % 40) * 25 + byte_offset % 60 AS t, CASE WHEN seq % 3 = 0 THEN (seq % 40) * 20 ELSE 0 END AS s, (seq % 40) * 22 AS b FROM ev),
l AS (SELECT bank_id, session_id, list({{'c': 0::BIGINT, 'm': 0::BIGINT, 'f': f::BIGINT, 't': t::BIGINT, 's': s::BIGINT, 'b': b::BIGINT}} ORDER BY seq) AS x FROM r GROUP BY ALL)
SELECT bank_id, session_id, list_reduce(list_prepend({{'c': 0::BIGINT, 'm': 0::BIGINT, 'f': 0::BIGINT, 't': 0::BIGINT, 's': 0::BIGINT, 'b': 0::BIGINT}}, x), lambda a, y:
 {{'c': greatest(a.c, CASE WHEN a.c >= y.f THEN y.t ELSE 0 END, CASE WHEN a.c >= a.m THEN y.s ELSE 0 END), 'm': greatest(a.m, y.b), 'f': 0::BIGINT, 't': 0::BIGINT, 's': 0::BIGINT, 'b': 0::BIGINT}}).c AS confirmed FROM l""",
)
def confirmed(t: Tables) -> DataFrame:
    n = F.col("seq") % 40
    rows = _events(t).select("bank_id", "session_id", "seq", (n * 25).alias("from_offset"), (n * 25 + F.col("byte_offset") % 60).alias("to_offset"), F.when(F.col("seq") % 3 == 0, n * 20).otherwise(0).cast("long").alias("settled"), (n * 22).alias("byte_offset"))
    return ST.confirmed_offsets(rows)


@query("st3_turn_gate", f"WITH {_EV}, n AS (SELECT session_id::VARCHAR AS session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM ev) SELECT session_id, seq FROM n WHERE turn % 5 = 0")
def turn_gate(t: Tables) -> DataFrame:
    turns = _events(t).withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))
    return turns.filter(ST.retains_now(F.col("turn"), 5)).select("session_id", "seq")


@query(
    "st4_cursors",
    f"""WITH {_EV}, j AS (SELECT bank_id, session_id::VARCHAR AS session_id, seq, seq * 10 AS f, seq * 10 + 7 AS t, seq % 13 AS c, CASE WHEN seq % 17 = 0 THEN 'running' WHEN seq % 5 = 0 THEN 'failed' ELSE 'done' END AS status FROM ev),
o AS (SELECT bank_id, session_id, min(seq) FILTER (status = 'running') AS o FROM j GROUP BY ALL), s AS (SELECT j.* FROM j JOIN o ON o.bank_id = j.bank_id AND o.session_id = j.session_id WHERE o.o IS NULL OR j.seq < o.o),
l AS (SELECT bank_id, session_id, arg_max(CASE status WHEN 'done' THEN t ELSE f END, seq) AS cursor, arg_max(CASE status WHEN 'done' THEN c + 1 ELSE c END, seq) AS chunk FROM s GROUP BY ALL)
SELECT o.bank_id, o.session_id, coalesce(l.cursor, 0) AS cursor, coalesce(l.chunk, 0) AS chunk, o.o IS NOT NULL AS waiting FROM o LEFT JOIN l ON l.bank_id = o.bank_id AND l.session_id = o.session_id""",
)
def cursors(t: Tables) -> DataFrame:
    s = F.col("seq")
    status = F.when(s % 17 == 0, "running").when(s % 5 == 0, "failed").otherwise("done")
    return ST.reconciled(_events(t).select("bank_id", "session_id", "seq", (s * 10).alias("from_offset"), (s * 10 + 7).alias("to_offset"), (s % 13).alias("chunk_before"), status.alias("status")))


@query(
    "st5_throttled",
    f"WITH {_EV} SELECT seq, seq % 9 >= 5 AND ms <= 1704412800000 AND 1704412800000 - ms < 60000000 AS held, CASE WHEN seq % 4 = 0 THEN ms <= 1704412800000 AND 1704412800000 < ms + 36000000 ELSE false END AS poisoned FROM ev",
)
def throttled(t: Tables) -> DataFrame:
    now = 1_704_412_800_000
    return _events(t).select("seq", ST.breaker_open(F.col("seq") % 9, F.col("at"), now, 5, 60_000_000).alias("held"), ST.poisoned(F.when(F.col("seq") % 4 == 0, F.col("at")), now, 36_000_000).alias("poisoned"))


@query("u6_listed", f"WITH {_EV}, s AS (SELECT bank_id, session_id::VARCHAR AS session_id, max(ms) AS last_seen FROM ev GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY last_seen DESC, session_id) AS nth FROM s WHERE last_seen >= 1706000000000 QUALIFY nth <= 7")
def listed(t: Tables) -> DataFrame:
    return ST.list_sessions(_events(t).groupBy("bank_id", "session_id").agg(F.max("at").alias("last_seen")), 1_706_000_000_000, 7)


@query(
    "st8_admitted",
    f"""WITH {_EV}, r AS (SELECT session_id::VARCHAR AS session_id, seq, byte_offset + 1 AS b FROM ev),
l AS (SELECT session_id, list({{'j': 0::BIGINT, 'h': 0::BIGINT, 'b': b::BIGINT, 's': seq::BIGINT, 'out': []::BIGINT[]}} ORDER BY seq) AS x FROM r GROUP BY 1),
d AS (SELECT session_id, list_reduce(list_prepend({{'j': 0::BIGINT, 'h': 0::BIGINT, 'b': 0::BIGINT, 's': 0::BIGINT, 'out': []::BIGINT[]}}, x), lambda a, y: CASE WHEN a.j < 4 AND a.h + y.b <= 20000 THEN {{'j': a.j + 1, 'h': a.h + y.b, 'b': 0::BIGINT, 's': 0::BIGINT, 'out': list_append(a.out, y.s)}} ELSE a END).out AS o FROM l)
SELECT r.session_id, r.seq, list_contains(d.o, r.seq) AS accepted FROM r JOIN d ON d.session_id = r.session_id""",
)
def admitted(t: Tables) -> DataFrame:
    """The events of a user stand for what comes in between two drains of a queue of four jobs and 20,000 bytes."""
    return ST.admitted(_events(t).select("session_id", "seq", (F.col("byte_offset") + 1).alias("bytes")), ["session_id"], 4, 20_000)


@query(
    "st9_drained",
    "WITH b AS (SELECT id, bank_id, text, row_number() OVER (PARTITION BY bank_id ORDER BY id) AS nth FROM memory_nodes WHERE id NOT IN (SELECT node_id FROM node_vectors WHERE embedding IS NOT NULL)) SELECT id AS node_id, bank_id, length(text) AS first FROM b WHERE nth <= 40 AND length(text) % 7 <> 0",
)
def drained(t: Tables) -> DataFrame:
    """Two rounds of twenty a bank; the model gives the length of a text, and fails at every seventh."""
    embed = lambda text: F.when(F.length(text) % 7 != 0, F.array(F.length(text).cast("double"), F.lit(1.0)))
    made = ST.drain(t("memory_nodes"), t("node_vectors"), embed, "m", 20, 2)
    return made.select("node_id", "bank_id", F.col("embedding")[0].cast("long").alias("first"))


@query(
    "st10_tick",
    f"""WITH {_PENDING}, n AS (SELECT b.bank_id, (SELECT count(*) FROM pend p WHERE p.bank_id = b.bank_id) AS k FROM banks b), q AS (SELECT DISTINCT bank_id FROM documents WHERE doc_id % 20 = 0)
SELECT bank_id, CASE WHEN k = 0 THEN 'idle' WHEN bank_id IN (FROM q) THEN 'deferred' ELSE 'round' END AS state FROM n""",
)
def tick(t: Tables) -> DataFrame:
    """Every twentieth document stands for a text that is still queued."""
    counts = C.pending(t("memory_nodes"), C.watermarks(t("bank_reports"))).groupBy("bank_id").agg(F.count(F.lit(1)).alias("pending"))
    return ST.consolidation_tick(t("banks").select("bank_id").join(counts, "bank_id", "left"), t("documents").filter("doc_id % 20 = 0"))
