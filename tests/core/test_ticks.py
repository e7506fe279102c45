import json

from pyspark.sql import functions as F

from mnestra.operators import curation as C
from mnestra.operators import retrieval as R
from mnestra.streaming import sessions as ST


def test_a_source_takes_few_files_at_a_time(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(5):
        (source / f"{n}.json").write_text(json.dumps({"id": n, "bank_id": "b", "text": "x" * n}))
    seen = []
    stream = ST.limited_source(spark, str(source), "id long, bank_id string, text string", files=2)
    run = ST.drain_stream(stream, lambda text: F.array(F.length(text).cast("double")), "m", lambda df, number: seen.append(sorted(tuple(r) for r in df.select("node_id", F.col("embedding")[0]).collect())), str(tmp_path / "state"))
    run.awaitTermination()
    assert [len(s) for s in seen] == [2, 2, 1] and sorted(x for s in seen for x in s) == [(n, float(n)) for n in range(5)]


def test_a_queue_turns_away_what_does_not_fit(spark):
    rows = [("a", n, b) for n, b in enumerate([5, 6, 5, 1, 1])] + [("b", 0, 11), ("b", 1, 10)]
    df = spark.createDataFrame(rows, "tick string, seq long, bytes long")
    got = {(r["tick"], r["seq"]): r["accepted"] for r in ST.admitted(df, ["tick"], 2, 10).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("a", 3): False, ("a", 4): False, ("b", 0): False, ("b", 1): True}


def test_jobs_are_settled_in_order(spark):
    jobs = [("b", "s", 1, 0, 10, 0, "done"), ("b", "s", 2, 10, 20, 1, "failed"), ("b", "s", 3, 10, 25, 1, "running"), ("b", "s", 4, 25, 30, 2, "done"), ("b", "t", 1, 0, 5, 0, "pending")]
    df = spark.createDataFrame(jobs, "bank_id string, session_id string, seq long, from_offset long, to_offset long, chunk_before long, status string")
    assert {r["session_id"]: (r["cursor"], r["chunk"], r["waiting"]) for r in ST.reconciled(df).collect()} == {"s": (10, 1, True), "t": (0, 0, True)}


def test_knn_cells_give_the_same_as_one(spark):
    rows = [(n, "b" if n % 3 else "c", [float((n * 7) % 11), float(n % 5), 1.0]) for n in range(60)] + [(99, "b", None)]
    vectors = spark.createDataFrame(rows, "node_id long, bank_id string, embedding array<double>")
    asked = vectors.select(F.col("node_id").alias("qid"), "bank_id", F.col("embedding").alias("vector"))
    one, many = ({tuple(r) for r in R.knn(asked, vectors, 4, block, query_block=part).collect()} for block, part in ((10_000, 10_000), (7, 5)))
    assert one == many and len(one) == 60 * 4


def test_prompts_shed_in_order(spark):
    facts = spark.createDataFrame([("m", 1, 10), ("m", 2, 10), ("n", 1, 90), ("o", 1, 10)], "model_id string, place int, tokens int")
    models = spark.createDataFrame([("m", 15), ("n", 1), ("o", 20)], "model_id string, tokens int")
    got = {r["model_id"]: (r["with_content"], r["kept"], r["total"]) for r in C.assemble_refresh(facts, models, 5, 35).collect()}
    assert got == {"m": (False, 2, 25), "o": (True, 1, 35)}
    memories = spark.createDataFrame([("q", 1, 10), ("q", 2, 10), ("r", 1, 5), ("s", 1, 50)], "qid string, place int, tokens int")
    curated = spark.createDataFrame([("q", 1, 10), ("r", 1, 40)], "qid string, place int, tokens int")
    got = {r["qid"]: (r["memories"], r["models"]) for r in C.assemble_reflection(memories, curated, 0, 25).collect()}
    assert got == {"q": (1, 1)}
