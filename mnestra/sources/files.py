"""Readers and writers of the formats around the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnestra.session import materialise

FACT = (
    "struct<text:string,fact_type:string,context:string,event_date:string,occurred_start:string,occurred_end:string,mentioned_at:string,"
    "metadata:map<string,string>,tags:array<string>,chunk_index:bigint,entities:array<string>,"
    "causal_relations:array<struct<relation_type:string,target_fact_index:bigint>>,created_at:string,consolidated_at:string,consolidation_failed_at:string>"
)
DOCUMENT = f"id string, original_text string, tags array<string>, created_at string, facts array<{FACT}>, _bad string"
CORPUS = "id string, text string, context string, fact_type string, date string, mentioned_at string, occurred_start string, occurred_end string, entities string, proof_count bigint, tags array<string>"
GOLD = "id string, stratum string, query string, labels_status string, note string, labels array<struct<uuid:string,grade:int,why:string>>"


def classify_lines(lines: DataFrame) -> DataFrame:
    """Lines of a session log as (line_no, kind, role, content): ``message``, ``compaction`` or ``other``.

    A message is a user or assistant entry, or a bare object with role and content.
    """
    j = lambda path: F.get_json_object("value", path)
    role = F.coalesce(j("$.message.role"), j("$.role"))
    content = F.coalesce(j("$.message.content"), j("$.content"))
    typed = j("$.type")
    message = role.isin("user", "assistant") & content.isNotNull() & (typed.isNull() | typed.isin("user", "assistant"))
    kind = F.when(j("$.subtype") == "compact_boundary", "compaction").when(F.coalesce(message, F.lit(False)), "message").otherwise("other")
    return lines.select("line_no", kind.alias("kind"), F.when(kind == "message", role).alias("role"), F.when(kind == "message", content).alias("content"))


def newest_within(lines: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """The newest lines of every log whose sizes add up to at most ``most``."""
    run = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_sum", F.sum(size).over(run)).filter(F.col("_sum") <= most).drop("_sum")


def read_log(spark: SparkSession, path: str, from_offset: int = 0) -> DataFrame:
    """Whole lines of a log from a byte offset on: (path, line_no, offset, value); a torn last line is held back.

    A log file is one row of bytes, so this suits session logs, not archives of any size.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", F.expr(f"substring(content, {from_offset + 1}, length(content))").alias("b"))
    text = raw.select("path", F.decode("b", "UTF-8").alias("t"))
    whole = text.select("path", F.posexplode(F.split(F.regexp_replace("t", r"[^\n]*$", ""), "\n")).alias("line_no", "value")).filter("value <> ''")
    end = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return whole.withColumn("offset", F.lit(from_offset) + end)


def read_delta(logs: DataFrame, from_offset: int = 0, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What is new in session logs: messages, and one row a log.

    ``logs(path, content)`` with the bytes of a log.  Gives ``messages(path, line_no, role, content, size)`` and
    ``states(path, consumed_to, compactions, truncated)``.  Only whole lines are consumed.  Of the messages the newest stay
    whose sizes as JSON, with a comma each and a bracket, are within ``max_bytes``.  A log is one row, as are its lines.
    """
    tail = logs.select("path", F.expr(f"substring(content, {from_offset + 1}, length(content))").alias("b"))
    text = tail.select("path", F.decode("b", "UTF-8").alias("t"))
    whole = text.select("path", F.regexp_replace("t", r"[^\n]*$", "").alias("t"))
    lines = whole.select("path", F.posexplode(F.split("t", "\n")).alias("line_no", "value")).filter("value <> ''")
    judged = classify_lines(lines.select(F.struct("path", "line_no").alias("line_no"), "value"))
    sizes = judged.select("line_no.path", "line_no.line_no", "kind", "role", "content", (F.octet_length(F.to_json(F.struct("role", "content"))) + 1).alias("size"))
    messages = sizes.filter("kind = 'message'").drop("kind")
    kept = messages if max_bytes is None else newest_within(messages, "path", "line_no", "size", max_bytes - 1)
    counts = sizes.groupBy("path").agg(F.count_if(F.col("kind") == "compaction").alias("compactions"), F.coalesce(F.sum(F.when(F.col("kind") == "message", F.col("size"))), F.lit(0)).alias("all"))
    states = whole.select("path", (F.lit(from_offset) + F.octet_length("t")).alias("consumed_to")).join(counts, "path", "left")
    cut = F.lit(False) if max_bytes is None else F.coalesce(F.col("all") + 1 > max_bytes, F.lit(False))
    return kept, states.select("path", "consumed_to", F.coalesce("compactions", F.lit(0)).alias("compactions"), cut.alias("truncated"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a transfer archive (``documents/*.json``), one row a fact with its position; unreadable files fail."""
    docs = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(DOCUMENT.replace(", _bad string", "")).json(f"{path}/documents")
    return docs.select(F.col("id").alias("document_id"), F.posexplode("facts").alias("fact_index", "f")).select("document_id", "fact_index", "f.*")


def read_archives(spark: SparkSession, path: str):
    """All archives below a folder, with manifests and observations; see ``operators.archive.parse_archive``."""
    from mnestra.operators.archive import parse_archive

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return parse_archive(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def unknown_fields(raw: DataFrame, known: list[str]) -> DataFrame:
    """(line_no, fields): keys of JSON objects that are not known."""
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    return raw.select("line_no", F.array_except(keys, F.array(*[F.lit(k) for k in known])).alias("fields")).filter(F.size("fields") > 0)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(qid, stratum, query, uuid, grade) of labelled queries; raises if a label has no reason or a grade above 2."""
    rows = spark.read.schema(GOLD).json(path).select(F.col("id").alias("qid"), "stratum", "query", F.explode("labels").alias("l")).select("qid", "stratum", "query", "l.*")
    wrong = rows.filter(~F.coalesce(F.col("grade").between(0, 2), F.lit(False)) | (F.trim(F.coalesce("why", F.lit(""))) == "")).count()
    if wrong:
        raise ValueError(f"{wrong} labels without a reason or with a grade that is not 0, 1 or 2")
    return rows.drop("why")


def export_corpus(facts: DataFrame) -> DataFrame:
    """Facts for an evaluation corpus: each id once, tags sorted, entities joined."""
    first = facts.withColumn("_n", F.row_number().over(Window.partitionBy("document_id", "fact_index").orderBy("row_id"))).filter("_n = 1")
    key = F.concat_ws("#", "document_id", "fact_index")
    return first.select(key.alias("id"), "text", "context", "fact_type", "mentioned_at", F.array_join("entities", ", ").alias("entities"), F.array_sort("tags").alias("tags"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha256"))


def checksum_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of files that are missing, new or changed."""
    both = expected.select("path", F.col("sha256").alias("e")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "new").when(F.col("a") != F.col("e"), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")


def append_json(rows: DataFrame, path: str) -> None:
    """Append to a JSON ledger."""
    rows.write.mode("append").json(path)


def append_rotated(rows: DataFrame, path: str, most_bytes: int = 10_000_000, keep: int = 3) -> int:
    """Append to the JSON log ``path/current``; a log of more than ``most_bytes`` first moves to ``path/1``, 1 to 2 and so on.

    At most ``keep`` old logs stay.  Gives the size in bytes of the current log before it was written to.
    """
    spark = rows.sparkSession
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    current = make(f"{path}/current")
    size = system.getContentSummary(current).getLength() if system.exists(current) else 0
    if size > most_bytes:
        system.delete(make(f"{path}/{keep}"), True)
        for n in range(keep - 1, 0, -1):
            if system.exists(make(f"{path}/{n}")):
                system.rename(make(f"{path}/{n}"), make(f"{path}/{n + 1}"))
        system.rename(current, make(f"{path}/1"))
        size = 0
    append_json(rows, f"{path}/current")
    return size


def pool_dump(results: DataFrame) -> DataFrame:
    """(qid, pool): what a query retrieved, as JSON in the order of its ranks, for labelling."""
    item = F.struct("rank", *[c for c in results.columns if c not in ("qid", "rank")])
    return results.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("pool"))


def json_responses(rows: DataFrame, key: str) -> DataFrame:
    """(key, body): a JSON body for every row."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("body"))


def insert_nodes(new: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """New nodes with ids that go on from the highest stored one, by bank and then in the given order.

    Rows are parted by ranges and numbered within their part; the sizes of the parts before are
    added, so no single task orders all rows of a bank.
    """
    parts = max(1, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = new.repartitionByRange(parts, "bank_id", *order).sortWithinPartitions("bank_id", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(ranged.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit(2**33 - 1))}).drop("_at"), "ranged")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    most = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    return placed.join(F.broadcast(starts), "_part").join(F.broadcast(most)).withColumn("id", F.col("_max") + F.col("_before") + F.col("_nth") + 1).drop("_max", "_before", "_nth", "_part")
