import random

import pytest

from mnestra.llm.spans import shared_passages, shared_spans


def brute(rows, span):
    texts = {}
    for doc, text in rows:
        if doc is not None and text is not None:
            texts.setdefault(doc, set()).add(text)
    where = {}
    for doc, some in texts.items():
        for text in some:
            for i in range(len(text) - span + 1):
                where.setdefault(text[i : i + span], set()).add(doc)
    out = {}
    for doc, some in texts.items():
        total = 0
        for text in some:
            covered = set()
            for i in range(len(text) - span + 1):
                if len(where[text[i : i + span]]) > 1:
                    covered.update(range(i, i + span))
            total += len(covered)
        if total:
            out[doc] = total
    return out


def rows_of(df):
    return {r["doc_id"]: r["shared_chars"] for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcd 한é\U0001f600"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [make(rng.choice([15, 19, 20, 21, 30, 60])) for _ in range(8)]
    rows = []
    for i in range(60):
        rows.append((i, "".join(rng.choice(parts) if rng.random() < 0.5 else make(rng.randint(0, 30)) for _ in range(rng.randint(0, 6)))))
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 250 + "b"), (5, rows[5][1]), (104, rows[6][1]), (105, rows[6][1])]
    for i, unit in enumerate(["a", "ab", "abc ", "한", "abcdefghijk", "xy" * 7 + "z"]):
        long = unit * (400 // len(unit))
        rows += [(200 + 10 * i, make(30) + long + make(30)), (201 + 10 * i, make(5) + long[3:200] + make(9) + long[:21]), (202 + 10 * i, make(9) + long[7:27] + make(9)), (203 + 10 * i, long[1:60])]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 50_000), (3, 2), (4, 50_000)])
def test_spans_equal_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as prefix", "1 as pos", "2 as mark")
    assert rows_of(shared_spans(df, 20, hot_rows=hot, flush_rows=50)) == brute(rows, 20)


def test_passages_are_the_shared_parts(spark):
    rows = [(1, "x" + "0123456789" * 3 + "y" + "abcdefghij" * 2), (2, "0123456789" * 3), (3, "--" + "abcdefghij" * 2), (4, "nothing in common at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (50_000, 1):
        assert {tuple(r) for r in shared_passages(df, 12, hot_rows=hot).drop("text_hash").collect()} == {(1, 1, 31), (1, 32, 52), (2, 0, 30), (3, 2, 22)}


def test_a_passage_in_a_third_of_all_texts(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = make(27)
    rows = [(i, make(rng.randint(0, 40)) + (common if i % 3 == 0 else "") + make(rng.randint(0, 40))) for i in range(150)]
    got = rows_of(shared_spans(spark.createDataFrame(rows, "doc_id long, text string"), 20, hot_rows=10, flush_rows=50))
    assert got == brute(rows, 20) and len(got) >= 50


def test_empty(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id long, text string"), 20).collect() == []


def test_long_texts_of_one_character(spark):
    rows = [(1, "a" * 20_000), (2, "b" + "a" * 300), (3, "c" * 5_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(shared_spans(df, 200)) == {1: 20_000, 2: 300}
