"""From transcripts to facts: capping, rendering, chunking, parsing, bookkeeping."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnestra.functions import text as T
from mnestra.functions.timex import relative_day
from mnestra.operators.retrieval import top

#: Blocks that the store itself put into a session, and the keys of a tool call kept first.
MEMORY_TAGS = ("memories", "relevant_memories")
PRIORITY_KEYS = ("file_path", "notebook_path", "path", "command", "description", "pattern", "query", "url")
MUTATING_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
OFFSET_MS = 10


def last_messages(messages: DataFrame, most: int = 300) -> DataFrame:
    """The last ``most`` messages of every session; 0 keeps all."""
    return messages if not most else top(messages, ["session_id"], [F.desc("turn")], most, "_nth").drop("_nth")


CHANNEL = r"(?s)<channel\b[^>]*>(.*?)</channel>"


def strip_channel(text: Column) -> Column:
    """The inner text of the first channel envelope; a text without one stays."""
    return F.when(text.rlike(CHANNEL), F.trim(F.regexp_extract(text, CHANNEL, 1))).otherwise(text)


def transcript_text(messages: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """(session_id, transcript, messages): rendered turns; sessions of under ten characters are left out."""
    body = F.trim(strip_channel(T.strip_blocks(F.col("content"), list(MEMORY_TAGS))))
    rows = messages.filter(F.col("role").isin(*roles)).select("session_id", "turn", "role", body.alias("body")).filter("body <> ''")
    line = F.concat(F.lit("[role: "), "role", F.lit("]\n"), "body", F.lit("\n["), "role", F.lit(":end]"))
    joined = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.count(F.lit(1)).alias("messages"))
    return joined.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("transcript"), "messages").filter(F.length("transcript") >= 10)


_TURN = re.compile(r"\[role: (\w+)\]\n(.*?)\n\[\1:end\]", re.S)


def split_turns(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, turn, role, content) of rendered transcripts: the inverse of ``transcript_text``."""
    whole = F.regexp_extract_all("text", F.lit(r"(?s)\[role: \w+\]\n.*?\n\[\w+:end\]"), F.lit(0))
    rows = documents.select(key, F.posexplode(whole).alias("turn", "block"))
    return rows.select(key, "turn", F.regexp_extract("block", r"^\[role: (\w+)\]", 1).alias("role"), F.regexp_extract("block", r"(?s)^\[role: \w+\]\n(.*)\n\[\w+:end\]$", 1).alias("content"))


def compact_tool_input(fields: Column, field_max: int = 300, total_max: int = 1500) -> Column:
    """Cut long fields of a tool call; if the whole is still too long, keep the telling keys and name the others."""
    cut = F.transform_values(fields, lambda _, v: F.when(F.length(v) > field_max, F.concat(F.substring(v, 1, field_max), F.lit("... (+"), (F.length(v) - field_max).cast("string"), F.lit(" chars)"))).otherwise(v))
    kept = F.map_filter(cut, lambda k, _: k.isin(*PRIORITY_KEYS))
    dropped = F.array_sort(F.array_except(F.map_keys(cut), F.map_keys(kept)))
    named = F.when(F.size(dropped) > 0, F.map_concat(kept, F.create_map(F.lit("_truncated_fields"), F.to_json(dropped)))).otherwise(kept)
    return F.when(F.length(F.to_json(cut)) > total_max, named).otherwise(cut)


_MEMORY = re.compile("|".join(rf"<{tag}>.*?</{tag}>" for tag in MEMORY_TAGS), re.S)
_CHANNEL = re.compile(CHANNEL)
_BLOCKS = "role string, blocks string, raw_blocks string, calls array<struct<nth int, name string, file_path string, notebook_path string>>"


def _compact(given, field_max: int, total_max: int) -> dict:
    if not isinstance(given, dict):
        return {}
    cut = {k: f"{v[:field_max]}... (+{len(v) - field_max} chars)" if isinstance(v, str) and len(v) > field_max else v for k, v in given.items()}
    if len(_dumps(cut)) <= total_max:
        return cut
    kept = {k: cut[k] for k in PRIORITY_KEYS if k in cut}
    dropped = sorted(set(cut) - set(kept))
    return kept | {"_truncated_fields": dropped} if dropped else kept


def _dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _cleaned(value) -> str:
    text = _MEMORY.sub("", value) if isinstance(value, str) else ""
    inner = _CHANNEL.search(text)
    return (inner.group(1) if inner else text).strip()


def _texts(items: list) -> str:
    said = [i["text"].strip() for i in items if isinstance(i, dict) and i.get("type") == "text" and isinstance(i.get("text"), str)]
    return "\n".join(t for t in said if t)


def content_blocks(content, role: str, field_max: float = 300, total_max: float = 1500, result_max: float = 2000) -> list[dict]:
    """The text, tool calls (of the assistant) and tool results of a message's content, each within its cap."""
    if isinstance(content, str):
        content = [{"type": "text", "text": content}]
    out = []
    for block in content if isinstance(content, list) else []:
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text":
            text = _cleaned(block.get("text"))
            if text:
                out.append({"type": "text", "text": text})
        elif kind == "tool_use" and role == "assistant":
            name = block["name"] if isinstance(block.get("name"), str) else "unknown"
            if not (name.startswith("mcp__") and any(m in name.split("__")[-1].lower() for m in T.OPERATIONAL)):
                out.append({"type": "tool_use", "name": name, "input": _compact(block.get("input"), field_max, total_max)})
        elif kind == "tool_result":
            got = block.get("content")
            text = got.strip() if isinstance(got, str) else _texts(got) if isinstance(got, list) else ""
            if text:
                by = block.get("tool_use_id")
                out.append({"type": "tool_result", "tool_use_id": by if isinstance(by, str) else "", "content": text if len(text) <= result_max else text[:result_max] + "... (truncated)"})
    return out


def _message(line: str | None, caps: tuple[int, int, int]) -> tuple:
    none = (None, None, None, None)
    try:
        entry = json.loads(line or "null")
    except ValueError:
        return none
    if not isinstance(entry, dict) or entry.get("subtype") == "compact_boundary" or entry.get("type") not in (None, "user", "assistant"):
        return none
    message = entry["message"] if isinstance(entry.get("message"), dict) else entry
    role, content = message.get("role"), message.get("content")
    if role not in ("user", "assistant"):
        return none
    whole = lambda value: value.encode("utf-8", "replace").decode() if isinstance(value, str) else None
    written = lambda blocks: whole(_dumps({"role": role, "content": blocks})) if blocks else None
    calls = []
    for nth, block in enumerate(content if isinstance(content, list) and role == "assistant" else []):
        if isinstance(block, dict) and block.get("type") == "tool_use" and isinstance(block.get("input"), dict):
            calls.append({"nth": nth, "name": whole(block.get("name")), "file_path": whole(block["input"].get("file_path")), "notebook_path": whole(block["input"].get("notebook_path"))})
    uncapped = (float("inf"),) * 3
    return role, written(content_blocks(content, role, *caps)), written(content_blocks(content, role, *uncapped)), calls


def message_blocks(lines: DataFrame, caps: tuple[int, int, int] = (300, 1500, 2000)) -> DataFrame:
    """(session_id, turn, role, blocks, raw_blocks, calls) of the messages in the JSON lines of session logs.

    ``lines(session_id, turn, value)``; ``blocks`` is the message as JSON with
    every block within ``caps`` (fields of a tool call, the whole call, a tool
    result), ``raw_blocks`` the same without caps, null where no block is left.
    Calls of tools that only operate the store are dropped.
    """

    @F.pandas_udf(_BLOCKS)
    def parsed(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_message(v, caps) for v in values], columns=["role", "blocks", "raw_blocks", "calls"])

    return lines.select("session_id", "turn", parsed("value").alias("m")).select("session_id", "turn", "m.*").filter("role is not null")


def plan_sessions(lines: DataFrame, cwd: str = "", caps: tuple[int, int, int] = (300, 1500, 2000)) -> DataFrame:
    """(session_id, transcript, messages, raw_tokens, capped_tokens, saved_ratio, files) of session logs, the caps applied block by block."""
    found = message_blocks(lines, caps)
    whole = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("turn", c)))), lambda x: x[c]), ","), F.lit("]"))
    rows = found.filter("blocks is not null").groupBy("session_id").agg(whole("blocks").alias("transcript"), whole("raw_blocks").alias("raw"), F.count(F.lit(1)).alias("messages"))
    calls = found.select("session_id", "turn", "role", F.explode("calls").alias("c")).select("session_id", "turn", "role", "c.*", F.lit(cwd).alias("cwd"))
    raw, kept = T.count_words(F.col("raw")), T.count_words(F.col("transcript"))
    sized = rows.select("session_id", "transcript", "messages", raw.alias("raw_tokens"), kept.alias("capped_tokens"), F.round(F.when((raw > 0) & (kept > 0), 1 - F.least(kept, raw) / raw), 6).alias("saved_ratio"))
    return sized.join(touched_files(calls), "session_id", "left")


def touched_files(calls: DataFrame, most: int = 20) -> DataFrame:
    """(session_id, files): the files that tool calls changed, in the order of the first touch.

    ``calls(session_id, turn, nth, role, name, file_path, notebook_path, cwd)``.
    """
    path = F.trim(F.coalesce(F.when(F.trim("file_path") != "", F.col("file_path")), F.when(F.trim("notebook_path") != "", F.col("notebook_path"))))
    base = F.element_at(F.split("name", "__"), -1)
    prefix = F.concat(F.rtrim(F.col("cwd"), F.lit("/")), F.lit("/"))
    local = F.when((F.col("cwd") != "") & path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
    fine = (F.col("role") == "assistant") & base.isin(*MUTATING_TOOLS) & path.isNotNull() & (F.length(path) <= 512) & ~path.rlike(r"\p{Cntrl}")
    first = calls.filter(fine).select("session_id", "turn", "nth", local.alias("file")).groupBy("session_id", "file").agg(F.min(F.struct("turn", "nth")).alias("at"))
    chosen = top(first, ["session_id"], [F.col("at"), F.col("file")], most, "place")
    return chosen.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]).alias("files"))


def plan_ingest(documents: DataFrame, cap_chars: int = 2000) -> DataFrame:
    """Sizes, saving, content hash and repeats of documents before anything is stored.

    Adds ``raw_tokens, capped_tokens, saved_ratio, content_hash, nth_copy``; the
    first copy of a text in a bank has ``nth_copy`` 1.
    """
    capped = T.truncate(F.col("text"), cap_chars, "... (truncated)")
    raw, kept = T.count_words(F.col("text")), T.count_words(capped)
    rows = documents.select("doc_id", "bank_id", raw.alias("raw_tokens"), kept.alias("capped_tokens"), F.round(F.when((raw > 0) & (kept > 0), 1 - F.least(kept, raw) / raw), 6).alias("saved_ratio"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return top(rows, ["bank_id", "content_hash"], [F.col("doc_id")], None, "nth_copy")


def outcome(plan: DataFrame, min_tokens: int = 2) -> DataFrame:
    """Whether a document is skipped (too little text), a duplicate or accepted."""
    kind = F.when(F.col("raw_tokens") < min_tokens, "skipped").when(F.col("nth_copy") > 1, "duplicate").otherwise("accepted")
    return plan.withColumn("outcome", kind)


def savings_ledger(plan: DataFrame) -> DataFrame:
    """A ledger row for every document of which something was saved."""
    return plan.filter("raw_tokens > capped_tokens").select("bank_id", "doc_id", F.lit("retain_cap_saving").alias("kind"), F.to_json(F.struct("raw_tokens", "capped_tokens")).alias("detail"))


# --- chunks ---------------------------------------------------------------------------------------


def _pack(pieces: Iterator[str], most: int, finish) -> Iterator[str]:
    """Join neighbouring pieces while they fit; ``finish`` makes a chunk of them."""
    held: list[str] = []
    size = 0
    for piece in pieces:
        if held and size + len(piece) > most:
            yield finish(held)
            held, size = [], 0
        held.append(piece)
        size += len(piece)
    if held:
        yield finish(held)


def split_text(text: str, most: int, level: int = 0) -> list[str]:
    """Cut at the coarsest separator there is, and what is still too long at finer ones."""
    if len(text) <= most:
        return [text.strip()] if text.strip() else []
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        return [p for p in (text[i : i + most] for i in range(0, len(text), most)) if p.strip()]
    out: list[str] = []
    fitting: list[str] = []
    flush = lambda: (out.extend(c for c in _pack(iter(fitting), most, lambda held: "".join(held).strip()) if c), fitting.clear())
    for piece in re.findall(rf"(?s).*?{re.escape(SEPARATORS[level])}|.+$", text):
        if len(piece) <= most:
            fitting.append(piece)
        else:
            flush()
            out += split_text(piece, most, level + 1)
    flush()
    return out


def _structured(units: list[str], most: int, wrap: tuple[str, str], glue: str) -> list[str]:
    """Pack whole units into chunks of at most ``most`` characters; a unit too large is split as text."""
    room = most - len(wrap[0]) - len(wrap[1])
    out: list[str] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            out.append(wrap[0] + glue.join(held) + wrap[1])
        held.clear()
        size = 0

    for unit in units:
        if len(unit) > room:
            flush()
            out.extend(split_text(unit, most) or [unit])
            continue
        if held and size + len(unit) + len(glue) > room:
            flush()
        held.append(unit)
        size += len(unit) + len(glue)
    flush()
    return out


def chunk_text(text: str | None, most: int = 3000) -> list[str]:
    """Chunks of at most ``most`` characters that keep turns, lines and sentences whole where they can.

    Chunking a chunk again gives the chunk.  A null text has no chunks.
    """
    if text is None:
        return []
    if len(text) <= most:
        return [text]
    try:
        whole = json.loads(text)
    except (ValueError, RecursionError):
        whole = None
    if isinstance(whole, list) and all(isinstance(t, dict) for t in whole):
        return _structured([json.dumps(t, ensure_ascii=False, separators=(",", ":")) for t in whole], most, ("[", "]"), ",")
    if not isinstance(whole, dict):
        lines = [x for x in text.split("\n") if x.strip()]
        if len(lines) > 1 and all(x.lstrip().startswith("{") and _is_object(x) for x in lines):
            return _structured(lines, most, ("", ""), "\n")
    return split_text(text, most) or [text]


def _is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except (ValueError, RecursionError):
        return False


def chunks(documents: DataFrame, key: str = "doc_id", most: int = 3000) -> DataFrame:
    """(key, chunk_index, chunk): texts that fit stay in the JVM, the others are cut in Arrow batches."""
    short = documents.filter(F.length("text") <= most).select(key, F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, most))

    long = documents.filter(F.length("text") > most).select(key, F.posexplode(cut("text")).alias("chunk_index", "chunk"))
    return short.unionByName(long)


# --- facts ----------------------------------------------------------------------------------------

REPLY = (
    "array<struct<what:variant,factual_core:variant,text:variant,when:variant,who:variant,why:variant,fact_kind:variant,fact_type:variant,"
    "occurred_start:variant,occurred_end:variant,entities:array<string>,causal_relations:array<struct<target_index:bigint,relation_type:string>>>>"
)


_SAID = ("what", "factual_core", "text", "when", "who", "why", "fact_kind", "fact_type", "occurred_start", "occurred_end")


def parse_facts(replies: DataFrame, key: str = "reply_id") -> DataFrame:
    """Facts of replies ``(key, reply, event_ms)``, reply being a JSON array or an object with ``facts``.

    A field that is no string counts as absent, as do empty ones and "n/a".
    Facts without information or of over 2,000 characters go; at most 32 entities
    of at most 256 characters and two causes that stand before the fact stay; the
    positions of causes are renumbered after the facts that went.
    """
    whole = F.coalesce(F.from_json(F.get_json_object("reply", "$.facts"), REPLY), F.from_json("reply", REPLY))
    rows = replies.select(key, "event_ms", F.posexplode(whole).alias("raw_index", "f")).filter("f is not null")
    said = lambda name: F.when(F.schema_of_variant(F.col(f"f.{name}")) == "STRING", F.try_variant_get(F.col(f"f.{name}"), "$", "string")).alias(name)
    rows = rows.select(key, "event_ms", "raw_index", F.explode(F.array(F.struct(*[said(c) for c in _SAID], "f.entities", "f.causal_relations"))).alias("f"))  # read once, not at every use
    v = lambda name: T.truthy(F.col(f"f.{name}"))
    text = F.concat_ws(" | ", F.coalesce(v("what"), v("factual_core"), v("text")), F.concat(F.lit("When: "), v("when")), F.concat(F.lit("Involving: "), v("who")), v("why"))
    rows = rows.withColumn("fact", F.when(F.coalesce(v("what"), v("factual_core"), v("text")).isNotNull(), text))
    kind = F.when(F.col("f.fact_kind").isin("conversation", "event", "other"), F.col("f.fact_kind")).otherwise("conversation")
    rows = rows.filter(F.col("fact").isNotNull() & ~T.degenerate(F.col("fact")) & (F.length("fact") <= 2000)).withColumn("kind", kind)
    is_event = F.col("kind") == "event"
    inferred = F.date_format(F.timestamp_millis(relative_day(F.col("fact"), F.col("event_ms"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = F.when(is_event, F.coalesce(v("occurred_start"), inferred))
    entities = F.slice(F.filter(F.coalesce("f.entities", F.array().cast("array<string>")), lambda e: e.isNotNull() & (F.length(e) <= 256)), 1, 32)
    causes = F.slice(F.filter(F.coalesce("f.causal_relations", F.array().cast("array<struct<target_index:bigint,relation_type:string>>")), lambda r: r["relation_type"].isNotNull() & (r["target_index"] >= 0) & (r["target_index"] < F.col("raw_index"))), 1, 2)
    facts = rows.select(
        key,
        "raw_index",
        F.col("fact").alias("text"),
        F.when((F.col("f.fact_type") == "assistant") | (F.coalesce(v("fact_type"), F.lit("")) != "world") & (F.col("f.fact_kind") == "assistant"), "experience").otherwise("world").alias("fact_type"),
        F.col("kind").alias("fact_kind"),
        start.alias("occurred_start"),
        F.when(is_event, F.coalesce(v("occurred_end"), start)).alias("occurred_end"),
        entities.alias("entities"),
        causes.alias("causes"),
    )
    # a reply is one row of text, so the list of its facts is bounded by that row
    order = Window.partitionBy(key)
    survivors = F.array_sort(F.collect_list("raw_index").over(order))
    place = lambda i: F.array_position(F.col("survivors"), i.cast("int")) - 1
    facts = facts.withColumn("survivors", survivors)
    causes = F.filter(F.transform("causes", lambda r: F.struct(place(r["target_index"]).alias("target_index"), r["relation_type"].alias("relation_type"))), lambda r: r["target_index"] >= 0)
    return facts.withColumns({"fact_index": place(F.col("raw_index")), "causes": causes}).drop("survivors", "raw_index")


def augmented(text: Column, start: Column, end: Column, entities: Column) -> Column:
    """The text that is embedded: with its month, or span of months, and its entities."""
    one, two = T.month_and_year(start), T.month_and_year(end)
    when = F.when(start.isNull(), F.lit(None)).when(end.isNull() | (one == two), F.concat(F.lit("(happened in "), one, F.lit(")"))).otherwise(F.concat(F.lit("(happened from "), one, F.lit(" to "), two, F.lit(")")))
    who = F.when(F.size(F.coalesce(entities, F.array().cast("array<string>"))) > 0, F.concat(F.lit("["), F.array_join(entities, ", "), F.lit("]")))
    return F.concat_ws(" ", text, when, who)


def l2_normalise(vector: Column) -> Column:
    """Unit length; a vector without length stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def draft_nodes(facts: DataFrame) -> DataFrame:
    """Times of facts with ten milliseconds a position, so that their order lasts; event date and metadata."""
    shift = lambda c: F.col(c) + F.col("fact_index") * OFFSET_MS
    rows = facts.withColumns({c: shift(c) for c in ("occurred_start", "occurred_end", "mentioned_at")})
    return rows.withColumns({"event_date": F.coalesce("occurred_start", "mentioned_at"), "metadata": F.to_json(F.struct("document_id", "fact_index"))})


def job_state(chunks_done: DataFrame) -> DataFrame:
    """(job_id, chunks, failed, facts, status) of ``(job_id, ok, facts, aborted)`` rows, null ``ok`` being unfinished."""
    agg = chunks_done.groupBy("job_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("ok") == F.lit(False)).alias("failed"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.count_if(F.col("ok").isNull()).alias("open"), F.max(F.coalesce("aborted", F.lit(False))).alias("aborted"))
    done = ~F.col("aborted") & ((F.col("facts") >= 1) | (F.col("failed") == 0))
    status = F.when(F.col("aborted"), "failed").when(F.col("open") == F.col("chunks"), "pending").when(F.col("open") > 0, "running").when(done, "done").otherwise("failed")
    return agg.select("job_id", "chunks", "failed", "facts", status.alias("status"))


def fail_stale(jobs: DataFrame) -> DataFrame:
    """After a crash, what was pending or running has failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("pending", "running"), "failed").otherwise(F.col("status")))


def mission(request: Column, bank: Column, profile: Column) -> Column:
    return F.coalesce(F.nullif(request, F.lit("")), F.nullif(bank, F.lit("")), profile)


def derive_bank(cwd: Column, agent: Column, directories: dict[str, str], static: str | None = None) -> Column:
    """A bank id: that of the longest mapped directory above, a static one, else agent::last directory."""
    out = None
    for path in sorted(directories, key=len, reverse=True):
        hit = (cwd == path) | cwd.startswith(path.rstrip("/") + "/")
        out = F.when(hit, directories[path]) if out is None else out.when(hit, directories[path])
    root = F.regexp_replace(F.rtrim(cwd, F.lit("/")), r"/\.?worktrees/[^/]+(/.*)?$", "")
    rest = F.lit(static) if static else F.concat_ws("::", agent, F.element_at(F.split(root, "/"), -1))
    return rest if out is None else out.otherwise(rest)


def merge_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (bank_id, doc_key): the latest row wins, and an unchanged content hash changes nothing."""
    before = stored.select("bank_id", "doc_key", F.col("content_hash").alias("old_hash"))
    latest = top(new, ["bank_id", "doc_key"], [F.desc("written_at"), F.desc("content_hash")], 1, "_nth").drop("_nth")
    judged = latest.join(before, ["bank_id", "doc_key"], "left").withColumn("change", F.when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("updated"))
    kept = stored.join(judged.filter("change = 'updated'").select("bank_id", "doc_key"), ["bank_id", "doc_key"], "left_anti").withColumn("change", F.lit("stored"))
    changed = judged.filter("change <> 'unchanged'").drop("old_hash")
    return kept.select(*stored.columns, "change").unionByName(changed.select(*stored.columns, "change"))


def extraction_prompt(chunk: Column, event_ms: Column, mission_text: Column) -> Column:
    return F.concat(F.lit("Mission: "), mission_text, F.lit("\nEvent date: "), T.day_name_date(event_ms), F.lit("\n\n"), chunk)
