from pyspark.sql import functions as F

from mnestra.operators.diff import differences

SCHEMA = "k string, n long, a string, b long, fields string"


def run(spark, left, right):
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    key, columns = [F.col("k"), F.col("n")], {"a": F.col("a"), "b": F.col("b")}
    out = differences(l, r, key, key, columns, columns).collect()
    return {(x["key_0"], x["key_1"]): (x["side"], [tuple(f) for f in x["fields"]]) for x in out}


def test_differences(spark):
    left = [("x", 1, "p", 1, ""), ("x", 1, "p", 1, ""), ("x", 2, "p", None, ""), ("x", 3, None, None, ""), (None, 4, "p", 1, ""), ("y", 5, "p", 1, ""), ("z", 6, "p", 1, ""), ("z", 6, "q", 1, ""), ("w", 7, "A ", 1, "")]
    right = [("x", 1, "p", 1, "e"), ("x", 2, "p", 3, ""), ("x", 3, None, None, ""), (None, 4, "p", 2, ""), ("v", 8, "p", 1, ""), ("z", 6, "p", 1, ""), ("w", 7, "a", 1, "")]
    assert run(spark, left, right) == {
        ("x", 2): ("both", [("b", None, "3")]),
        (None, 4): ("both", [("b", "1", "2")]),
        ("y", 5): ("left", []),
        ("v", 8): ("right", []),
        ("z", 6): ("both", [("a", "q", "p")]),
        ("w", 7): ("both", [("a", "A ", "a")]),
    }


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [("x", 1, "p", 1, "")]) == {("x", 1): ("right", [])}


def test_archive_differences_with_nulls_and_nothing(spark):
    from mnestra.operators.diff import archive_differences

    facts = "document_id string, fact_index long, text string, fact_type string, mentioned_at string, k0 string, l_there string"
    nodes = "document_id string, fact_index long, text string, fact_type string, mentioned_at long, archive_id string, held string"
    reports = "archive_id string, facts long, record_key string"
    a = [("d", 0, "t", "world", "1970-01-01T00:00:00.0019Z", "", ""), ("d", 0, "t", "world", "1970-01-01T09:00:00.001+09:00", "", ""), ("d", 1, None, None, None, "", ""), ("d", 2, "x", "world", "garbage", "", ""), (None, 3, "n", "world", None, "", "")]
    b = [("d", 0, "t", "world", 1, "a1", ""), ("d", 1, None, None, None, "a1", ""), ("d", 1, None, None, None, "a1", ""), ("d", 2, "x", "experience", None, "a1", ""), (None, None, "obs", "observation", None, None, "")]
    r = [("a1", 3, ""), ("a1", 3, ""), ("a2", 0, ""), ("a3", None, ""), ("a4", 5, "")]
    got = archive_differences(spark.createDataFrame(a, facts), spark.createDataFrame(b, nodes), spark.createDataFrame(r, reports)).collect()
    assert {tuple(x) for x in got} == {("d", 2, "fact_type"), ("d", 2, "mentioned_at"), (None, 3, "missing_in_store"), ("a3", -1, "facts"), ("a4", -1, "facts")}
    assert len(got) == 5
    assert archive_differences(*[spark.createDataFrame([], s) for s in (facts, nodes, reports)]).collect() == []


def test_rows_of_one_key_that_disagree(spark):
    rows = lambda n, values: [("k", n, v, 1, "") for v in values]
    left = rows(1, "abc") + rows(2, "ab") + rows(3, ["a", None]) + rows(4, "aa") + rows(5, [None, None])
    right = rows(1, "ac") + rows(2, "ab") + rows(3, ["a", None]) + rows(4, "a") + rows(5, [None])
    got = run(spark, left, right)
    assert set(got) == {("k", 1), ("k", 2), ("k", 3)} and all([f[0] for f in fields] == ["a"] for _, fields in got.values())
