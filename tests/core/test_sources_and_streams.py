import json

import pytest
from pyspark.sql import functions as F

from mnestra.operators import verify as V
from mnestra.sources import files
from mnestra.streaming import sessions as ST


def test_log_is_read_at_every_offset_without_loss(spark, tmp_path):
    lines = [json.dumps({"type": "user", "message": {"role": "user", "content": f"한글 {i}"}}, ensure_ascii=False) for i in range(4)]
    lines += [json.dumps({"type": "system", "subtype": "compact_boundary"}), json.dumps({"role": "assistant", "content": "bare"}), "not json"]
    whole = "\n".join(lines) + "\n"
    path = tmp_path / "log.jsonl"
    path.write_bytes(whole.encode() + b'{"torn')
    got = files.read_log(spark, str(path)).orderBy("line_no").collect()
    assert [r["value"] for r in got] == lines and got[-1]["offset"] == len(whole.encode())
    middle = got[2]["offset"]
    assert [r["value"] for r in files.read_log(spark, str(path), middle).orderBy("line_no").collect()] == lines[3:]
    kinds = files.classify_lines(files.read_log(spark, str(path))).orderBy("line_no").collect()
    assert [k["kind"] for k in kinds] == ["message"] * 4 + ["compaction", "message", "other"] and kinds[5]["role"] == "assistant"


def test_archive_corpus_and_gold(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    doc = {"id": "d1", "facts": [{"text": "a", "fact_type": "world", "tags": ["t"], "causal_relations": [{"relation_type": "caused_by", "target_fact_index": 1}]}, {"text": "b", "fact_type": "world", "metadata": {"k": "v"}}]}
    (tmp_path / "documents" / "000001.json").write_text(json.dumps(doc, indent=1))
    got = files.read_archive(spark, str(tmp_path)).orderBy("fact_index").collect()
    assert [(r["document_id"], r["fact_index"], r["text"]) for r in got] == [("d1", 0, "a"), ("d1", 1, "b")] and got[1]["metadata"] == {"k": "v"}
    raw = spark.createDataFrame([(1, json.dumps({"id": 1, "odd": 2})), (2, json.dumps({"id": 1}))], "line_no int, value string")
    assert [(r["line_no"], r["fields"]) for r in files.unknown_fields(raw, ["id"]).collect()] == [(1, ["odd"])]
    gold = {"id": "q", "stratum": "s", "query": "?", "labels": [{"uuid": "u", "grade": 2, "why": "w"}]}
    (tmp_path / "gold.jsonl").write_text(json.dumps(gold))
    assert files.read_gold(spark, str(tmp_path / "gold.jsonl")).first()["grade"] == 2
    gold["labels"][0]["grade"] = 3
    (tmp_path / "bad.jsonl").write_text(json.dumps(gold))
    with pytest.raises(ValueError):
        files.read_gold(spark, str(tmp_path / "bad.jsonl"))


def test_checksums_and_ledger(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a").write_text("1")
    (folder / "b").write_text("2")
    before = spark.createDataFrame(files.checksums(spark, str(folder)).collect())
    assert before.count() == 2
    (folder / "a").write_text("3")
    (folder / "b").unlink()
    (folder / "c").write_text("4")
    got = {r["path"][-1]: r["state"] for r in files.checksum_differences(before, files.checksums(spark, str(folder))).collect()}
    assert got == {"a": "changed", "b": "missing", "c": "new"}
    for i in range(2):
        files.append_json(spark.createDataFrame([(i,)], "n int"), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2


EVENTS = [("b", "s", i, i, i * 10, 1, 2, "src" if i == 3 else None, f"/w{i}" if i % 2 else None, 100 + i) for i in range(8)] + [("b", "t", 1, None, None, None, None, None, None, None)]
SCHEMA = "bank_id string, session_id string, seq long, turns long, byte_offset long, retains long, messages long, source string, cwd string, at long"


def test_stream_equals_batch(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame(EVENTS[n::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in ST.fold_sessions(spark.createDataFrame(EVENTS, SCHEMA)).collect()}
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r["bank_id"], r["session_id"]] = tuple(r)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = ST.stream_sessions(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert set(seen.values()) == want
    told = []
    f = ST.feed(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "session", lambda df, n: told.extend(df.collect()), str(tmp_path / "cp2"), "seq")
    assert f.awaitTermination(120)
    assert sorted(i for r in told for i in r["ids"]) == sorted([*range(8), 1]) and {r["kind"] for r in told} == {"session"}


def test_confirmed_offsets_need_joined_ranges(spark):
    rows = [("b", "s", 1, 0, 10), ("b", "s", 2, 20, 30), ("b", "s", 3, 5, 15), ("b", "s", 4, 15, 18), ("b", "t", 1, 4, 9)]
    got = {r["session_id"]: r["confirmed"] for r in ST.confirmed_offsets(spark.createDataFrame(rows, "bank_id string, session_id string, seq int, from_offset long, to_offset long")).collect()}
    assert got == {"s": 18, "t": 0}


def test_settled_offsets_count_where_nothing_is_open(spark):
    rows = [("b", "s", 1, None, None, 10, 10), ("b", "s", 2, 10, 20, None, 30), ("b", "s", 3, None, None, 40, 40), ("b", "t", 1, 0, 5, None, 5), ("b", "t", 2, None, None, 9, 9)]
    got = {r["session_id"]: r["confirmed"] for r in ST.confirmed_offsets(spark.createDataFrame(rows, "bank_id string, session_id string, seq int, from_offset long, to_offset long, settled long, byte_offset long")).collect()}
    assert got == {"s": 20, "t": 9}


def test_session_predicates(spark):
    df = spark.createDataFrame([(5, 6, 900), (5, 4, 900), (5, 6, 100), (0, 6, 2000)], "turns long, failures long, opened long")
    got = df.select(ST.retains_now(F.col("turns"), 5).alias("r"), ST.breaker_open(F.col("failures"), F.col("opened"), 1000, 5, 500).alias("o")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (True, False), (False, False)]
    after = spark.createDataFrame([("done",), ("failed",), ("running",)], "s string").select(ST.cursor_after(F.lit(1), F.lit(9), F.col("s")).alias("c")).collect()
    assert [r["c"] for r in after] == [9, 1, None]


def test_verdicts_and_samples(spark):
    checks = spark.createDataFrame([("a", "pass"), ("a", "review"), ("b", "fail"), ("b", "pass"), ("c", "pass")], "k string, state string")
    assert {r["k"]: r["verdict"] for r in V.verdict(checks, ["k"]).collect()} == {"a": "review", "b": "fail", "c": "pass"}
    rows = spark.createDataFrame([("x" if i < 90 else "y", i) for i in range(100)] + [("z", 500)], "k string, id int")
    first = V.stratified_sample(rows, "k", "id", 20, 1).collect()
    assert {k: sum(r["k"] == k for r in first) for k in "xyz"} == {"x": 18, "y": 2, "z": 1}
    assert {tuple(r) for r in first} == {tuple(r) for r in V.stratified_sample(rows, "k", "id", 20, 1).collect()}
    ledger = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 0.6)], "k string, n int, v double")
    assert V.against_baseline(ledger, spark.createDataFrame([("c", 0.6), ("d", 0.1)], "k string, v double"), ["k"], "n", "v").orderBy("k").select("same").collect() == [(True,), (False,)]
    bands = spark.createDataFrame([(1.5,), (1.9,), (None,)], "r double").select(V.in_band(F.col("r")).alias("s")).collect()
    assert [r["s"] for r in bands] == ["pass", "fail", "review"]
