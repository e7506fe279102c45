"""Session cursors, ticks and change feeds, as batch operators and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnestra.operators.retrieval import top
from mnestra.operators.store import backlog
from mnestra.session import materialise

STATE = "turns long, byte_offset long, retains long, messages long, source string, cwd string, last_seen long"
OUT = f"bank_id string, session_id string, {STATE}"


def fold_sessions(events: DataFrame) -> DataFrame:
    """(bank_id, session_id, ...): a session's state from its events, whatever their order.

    Counters grow to their maximum, increments add up, the first source and the
    last known directory (by ``seq``) stay.  Columns ``compactions`` (a counter), ``path`` and
    ``end_reason`` (the last known) are taken along where they are given.
    """
    first = F.min_by("source", F.when(F.col("source").isNotNull(), F.col("seq")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    more = [F.max("compactions").alias("compactions")] if "compactions" in events.columns else []
    more += [last(c).alias(c) for c in ("path", "end_reason") if c in events.columns]
    return events.groupBy("bank_id", "session_id").agg(
        F.max("turns").alias("turns"),
        F.max("byte_offset").alias("byte_offset"),
        F.coalesce(F.sum("retains"), F.lit(0)).alias("retains"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
        first.alias("source"),
        last("cwd").alias("cwd"),
        F.max("at").alias("last_seen"),
        *more,
    )


def confirmed_offsets(ranges: DataFrame) -> DataFrame:
    """(bank_id, session_id, confirmed) of ``(seq, from_offset, to_offset)`` rows: only ranges that join on count.

    A range counts if it begins at or before what is confirmed so far.  The order
    matters, so the ranges of a session are folded in order.  With the columns
    ``settled`` and ``byte_offset``, ``settled`` counts too where all that was
    read before (the highest ``byte_offset``) is confirmed.
    """
    ranges = ranges.withColumns({c: F.lit(None).cast("long") for c in ("settled", "byte_offset") if c not in ranges.columns})
    rows = ranges.groupBy("bank_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "from_offset", "to_offset", "settled", "byte_offset"))).alias("r"))
    confirmed = "greatest(s.c, if(x.from_offset <= s.c, x.to_offset, 0L), if(s.c >= s.b, x.settled, 0L))"
    fold = f"aggregate(r, struct(0L AS c, 0L AS b), (s, x) -> struct({confirmed} AS c, greatest(s.b, x.byte_offset) AS b), s -> s.c)"
    return rows.select("bank_id", "session_id", F.expr(fold).alias("confirmed"))


def retains_now(turns: Column, every: int) -> Column:
    """Whether a turn is one of those at which a session is retained."""
    return (turns % every == 0) & (turns > 0)


def catch_up(sessions: DataFrame, most: int = 3) -> DataFrame:
    """Sessions whose log is longer than what was read, the latest changed first."""
    behind = sessions.filter("file_size > byte_offset")
    return top(behind, ["bank_id"], [F.desc("modified_at"), F.col("session_id")], most, "nth")


def unconfirmed_bytes(sessions: DataFrame, most: int = 10) -> DataFrame:
    """(bank_id, sessions, bytes): what the latest sessions have read but not confirmed."""
    recent = top(sessions, ["bank_id"], [F.desc("last_seen"), F.col("session_id")], most, "nth")
    return recent.groupBy("bank_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.greatest(F.col("byte_offset") - F.col("confirmed"), F.lit(0))).alias("bytes"))


def expired(sessions: DataFrame, cutoff_ms: int) -> DataFrame:
    return sessions.filter(F.col("last_seen") < cutoff_ms)


def list_sessions(sessions: DataFrame, active_since: int | None = None, limit: int = 100) -> DataFrame:
    rows = sessions if active_since is None else sessions.filter(F.col("last_seen") >= active_since)
    return top(rows, ["bank_id"], [F.desc("last_seen"), F.col("session_id")], limit, "nth")


def breaker_open(failures: Column, opened_at: Column, now_ms: int, most: int = 5, pause_ms: int = 60_000) -> Column:
    """Whether calls are held back: after ``most`` failures, for a while; a stamp in the future doesn't hold."""
    return (failures >= most) & (opened_at <= now_ms) & (F.lit(now_ms) - opened_at < pause_ms)


def poisoned(poisoned_at: Column, now_ms: int, window_ms: int = 3_600_000) -> Column:
    """Whether a session that was rejected for good is not yet tried again; a stamp in the future doesn't hold."""
    return F.coalesce((poisoned_at <= now_ms) & (F.lit(now_ms) < poisoned_at + window_ms), F.lit(False))


def cursor_after(start: Column, end: Column, job_status: Column) -> Column:
    """Where a log is read on from: behind the delta if its job ended well, before it if it failed, else null (wait)."""
    return F.when(job_status == "done", end).when(job_status == "failed", start)


def reconciled(jobs: DataFrame) -> DataFrame:
    """(bank_id, session_id, cursor, chunk, waiting): where each session's log is read on from.

    ``jobs(bank_id, session_id, seq, from_offset, to_offset, chunk_before, status)``.  Jobs are settled in order up to the
    first that has not ended: a good one moves the cursor behind its delta, a failed one puts cursor and chunk back.
    """
    key = ["bank_id", "session_id"]
    open_ = jobs.filter(~F.col("status").isin("done", "failed")).groupBy(*key).agg(F.min("seq").alias("first_open"))
    settled = jobs.join(open_, key, "left").filter(F.col("first_open").isNull() | (F.col("seq") < F.col("first_open")))
    at = F.struct(cursor_after(F.col("from_offset"), F.col("to_offset"), F.col("status")).alias("cursor"), F.when(F.col("status") == "done", F.col("chunk_before") + 1).otherwise(F.col("chunk_before")).alias("chunk"))
    last = settled.groupBy(*key).agg(F.max_by(at, "seq").alias("at"))
    every = jobs.select(*key).distinct().join(last, key, "left").join(open_, key, "left")
    return every.select(*key, F.coalesce("at.cursor", F.lit(0).cast("long")).alias("cursor"), F.coalesce("at.chunk", F.lit(0).cast("long")).alias("chunk"), F.col("first_open").isNotNull().alias("waiting"))


def admitted(requests: DataFrame, by: list[str], most_jobs: int = 32, most_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """``requests(*by, seq, bytes)`` with ``accepted``: whether a queue that is emptied between groups takes each, in order.

    A request is turned away when the queue holds ``most_jobs`` or would hold more than ``most_bytes``; it then takes no room.
    """
    listed = requests.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("r"))
    fits = f"s.jobs < {most_jobs} AND s.held + x.bytes <= {most_bytes}L"
    fold = (
        "aggregate(r, named_struct('jobs', 0, 'held', 0L, 'out', cast(array() as array<struct<seq:bigint,accepted:boolean>>)), (s, x) -> named_struct("
        f"'jobs', s.jobs + int({fits}), 'held', s.held + if({fits}, x.bytes, 0L), 'out', array_append(s.out, named_struct('seq', x.seq, 'accepted', {fits}))), s -> s.out)"
    )
    typed = listed.withColumn("r", F.expr("transform(r, x -> named_struct('seq', cast(x.seq as bigint), 'bytes', cast(x.bytes as bigint)))"))
    return typed.select(*by, F.expr(f"inline({fold})"))


def limited_source(spark: SparkSession, path: str, schema: str, files: int | None = None, bytes_: int | None = None) -> DataFrame:
    """A stream of JSON files that takes at most so many files or bytes in a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if bytes_ is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_)
    return reader.json(path)


def drain(nodes: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], model: str, batch: int = 8, rounds: int | None = None) -> DataFrame:
    """Vectors of the nodes that have none, ``batch`` a bank and round by id, until none is left or ``rounds`` are over.

    ``embed(text)`` gives a vector column; a null keeps the node on the backlog without trying it again.
    """
    done: DataFrame | None = None
    waiting = materialise(backlog(nodes.select("id", "bank_id", "text"), vectors, None).select("id", "bank_id", "text", "nth"), "backlog")
    most = waiting.agg(F.max("nth")).first()[0] or 0
    for nth in range(min(-(-most // batch), rounds or most)):
        some = waiting.filter((F.col("nth") > nth * batch) & (F.col("nth") <= (nth + 1) * batch))
        made = some.select(F.col("id").alias("node_id"), "bank_id", embed(F.col("text")).alias("embedding"), F.lit(model).alias("embedding_model")).filter("embedding is not null")
        made = materialise(made, "embedded")
        done = made if done is None else done.unionByName(made)
    return done if done is not None else vectors.select("node_id", "bank_id", "embedding", "embedding_model").limit(0)


def drain_stream(stream: DataFrame, embed: Callable[[Column], Column], model: str, deliver: Callable[[DataFrame, int], None], checkpoint: str):
    """Embed new nodes ``(id, bank_id, text)`` micro-batch by micro-batch, and hand their vectors to ``deliver``."""

    def run(batch: DataFrame, number: int) -> None:
        deliver(batch.select(F.col("id").alias("node_id"), "bank_id", embed(F.col("text")).alias("embedding"), F.lit(model).alias("embedding_model")), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consolidation_tick(pending: DataFrame, queued: DataFrame) -> DataFrame:
    """(bank_id, state): which banks have a round at this tick.

    ``pending(bank_id, pending)``; a bank with facts to consolidate is ``deferred`` while texts of it are
    queued (``queued(bank_id)``), else has a ``round``; one without is ``idle``.
    """
    waits = queued.select("bank_id").distinct().withColumn("_queued", F.lit(True))
    state = F.when(F.coalesce("pending", F.lit(0)) == 0, "idle").when(F.col("_queued"), "deferred").otherwise("round")
    return pending.join(waits, "bank_id", "left").select("bank_id", state.alias("state"))


def sessionise(events: DataFrame, by: str, at: str, gap_ms: int) -> DataFrame:
    """Number the runs of a key's events that are no further apart than ``gap_ms``."""
    order = Window.partitionBy(by).orderBy(at, "event_id")
    starts = F.when(F.col(at) - F.lag(at).over(order) <= gap_ms, 0).otherwise(1)
    return events.withColumn("session_no", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def tick_snapshots(events: DataFrame, at: str = "ts", width: str = "60 seconds") -> DataFrame:
    """Counts and sums by tick; works on a table and, behind a watermark, on a stream."""
    return events.groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("tick"), "n", "total")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = list(state.get) if state.exists else [None, None, 0, 0, None, None, None]
    number = lambda x: None if pd.isna(x) else int(x)
    highest = lambda a, b: b if a is None else a if b is None else max(a, b)
    for pdf in batches:
        for r in pdf.sort_values("seq").itertuples(index=False):
            held[0], held[1] = highest(held[0], number(r.turns)), highest(held[1], number(r.byte_offset))
            held[2] += number(r.retains) or 0
            held[3] += number(r.messages) or 0
            held[4] = held[4] if held[4] is not None else (None if pd.isna(r.source) else r.source)
            held[5] = held[5] if pd.isna(r.cwd) else r.cwd
            held[6] = highest(held[6], number(r.at))
    state.update(tuple(held))
    yield pd.DataFrame([(*key, *held)], columns=["bank_id", "session_id", "turns", "byte_offset", "retains", "messages", "source", "cwd", "last_seen"])


def stream_sessions(events: DataFrame) -> DataFrame:
    """The same state kept over a stream, in update mode; only sessions with new events are told."""
    return events.groupBy("bank_id", "session_id").applyInPandasWithState(_advance, OUT, STATE, "update", "NoTimeout")


def change_feed(rows: DataFrame, kind: str, key: str = "id") -> DataFrame:
    """(bank_id, kind, ids) of new rows, for a sink; ids are sorted."""
    return rows.groupBy("bank_id").agg(F.lit(kind).alias("kind"), F.array_sort(F.collect_list(key)).alias("ids"))


def feed(stream: DataFrame, kind: str, deliver: Callable[[DataFrame, int], None], checkpoint: str, key: str = "id"):
    """Send every micro-batch of new rows to ``deliver`` as a change feed; checkpoints leave no gaps."""
    run = lambda batch, number: deliver(change_feed(batch, kind, key), number)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
