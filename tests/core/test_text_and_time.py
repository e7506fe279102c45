import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnestra.functions import cron
from mnestra.functions import text as T
from mnestra.functions import timex

NOW = int(dt.datetime(2025, 10, 15, 9, 30, 20, tzinfo=dt.timezone.utc).timestamp()) * 1000  # a Wednesday


def at(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * 1000


def days(kind_first_last):
    kind, first, last = kind_first_last
    if kind != "range":
        return kind
    day = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).strftime("%Y-%m-%d")
    assert first % timex.DAY_MS == 0 and (last + 1) % timex.DAY_MS == 0
    return day(first), day(last)


@pytest.mark.parametrize(
    "query,want",
    [
        ("does anyone know why it failed yesterday", ("2025-10-14", "2025-10-14")),
        ("the fix of the day before yesterday", ("2025-10-13", "2025-10-13")),
        ("last week's figures", ("2025-10-06", "2025-10-12")),
        ("who is on call this week", ("2025-10-13", "2025-10-19")),
        ("next week", ("2025-10-20", "2025-10-26")),
        ("the outage of last weekend", ("2025-10-11", "2025-10-12")),
        ("a couple of days ago", ("2025-10-12", "2025-10-14")),
        ("last month", ("2025-09-01", "2025-09-30")),
        ("next month", ("2025-11-01", "2025-11-30")),
        ("last year", ("2024-01-01", "2024-12-31")),
        ("merged since last week", ("2025-10-06", "2025-10-15")),
        ("since next week", "unconstrainable"),
        ("until last month", "unconstrainable"),
        ("after the launch last week", ("2025-10-06", "2025-10-12")),
        ("each friday we write it down", "unconstrainable"),
        ("each part of today", ("2025-10-15", "2025-10-15")),
        ("격주 점검", "unconstrainable"),
        ("지난주 고친 버그", ("2025-10-06", "2025-10-12")),
        ("지지난 달", ("2025-08-01", "2025-08-31")),
        ("지난주부터", ("2025-10-06", "2025-10-15")),
        ("지난달까지", "unconstrainable"),
        ("어제", ("2025-10-14", "2025-10-14")),
        ("재작년", ("2023-01-01", "2023-12-31")),
        ("재작성", None),
        ("notes of 2025-02-11, please", ("2025-02-11", "2025-02-11")),
        ("at 2025-02-11T23:30:00-05:00", ("2025-02-12", "2025-02-12")),
        ("build 20250211", None),
        ("2025-02-30", None),
        ("3월 9일 바꾼 것", ("2025-03-09", "2025-03-09")),
        ("12월 31일", ("2024-12-31", "2024-12-31")),
        ("2월 29일", ("2024-02-29", "2024-02-29")),
        ("2023년 3월 15일", ("2023-03-15", "2023-03-15")),
        ("2월 30일", None),
        ("yesterdays", None),
        ("", None),
        (None, None),
    ],
)
def test_windows(query, want):
    assert days(timex.window(query, NOW)) == want


@pytest.mark.parametrize(
    "expression,now,want",
    [
        ("* * * * *", NOW, NOW - 20_000),
        ("0 3 * * *", NOW, NOW - (6 * 3600 + 30 * 60 + 20) * 1000),
        ("0 10 * * *", NOW, NOW - (23 * 3600 + 30 * 60 + 20) * 1000),
        ("0 0 29 2 *", NOW, at(2024, 2, 29)),
        ("0 0 31 2 *", NOW, None),
        ("0 0 13 * 5", NOW, at(2025, 10, 13)),
        ("0 0 * * 7", NOW, at(2025, 10, 12)),
        ("5/20 8 * * *", NOW, at(2025, 10, 15, 8, 45)),
        ("60 * * * *", NOW, None),
        ("* * * *", NOW, None),
        ("*/0 * * * *", NOW, None),
        ("5-1 * * * *", NOW, None),
        ("a * * * *", NOW, None),
        (None, NOW, None),
    ],
)
def test_previous_fire(expression, now, want):
    assert cron.previous_fire(expression, now) == want


def test_due(spark):
    df = spark.createDataFrame([(1, "0 3 * * *", None), (2, "0 3 * * *", NOW - 86_400_000), (3, "0 3 * * *", NOW), (4, "bad", None), (5, None, None)], "i int, e string, r long")
    assert {r["i"]: r["d"] for r in df.select("i", cron.is_due(F.col("e"), F.col("r"), NOW).alias("d")).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.query_terms(t), t="Über the crème-brûlée, the 3rd über") == ["uber", "the", "creme", "brulee", "the", "3rd", "uber"]
    many = " ".join("x" * n for n in range(1, 16))
    assert one(spark, T.query_terms(t), t=many) == ["x" * n for n in range(4, 16)]
    assert one(spark, T.match_expression(t), t="--- !!") is None
    assert one(spark, T.match_expression(t), t="a b") == '"a"* OR "b"*'
    assert one(spark, T.label(t), t="a" * 160) == "a" * 160
    assert one(spark, T.label(t), t="a" * 161) == "a" * 159 + "…"
    assert one(spark, T.collapse(t), t="  a \n\t b ") == "a b"
    assert one(spark, T.count_words(t), t="  a \n\t b ") == 2 and one(spark, T.count_words(t), t=None) == 0
    assert one(spark, T.slug(t), t="coder::my bank") == "coder--my-bank"
    assert one(spark, T.percent_encode(t), t="a b/c*~") == "a%20b%2Fc%2A~"
    assert one(spark, T.clean_tags(t), t=[" a ", "", "c" * 129, "d", "e\u0007f"]) == ["a", "d"]
    assert one(spark, T.clean_tags(t), t=[f"t{i}" for i in range(40)]) == [f"t{i}" for i in range(32)]
    assert one(spark, T.strip_blocks(t, ["m"]), t="a<m>x</m>b<m>y</m>c<m>open") == "abc<m>open"
    assert one(spark, T.defang(t, "m"), t="</m><m>") != "</m><m>"
    for text, want in (("...", True), (" - ", True), ("?!", True), ("ok", False), ("a", False), ("", True), ("·", True), ("§", True), ("12", False)):
        assert one(spark, T.degenerate(t), t=text) is want, text
    for name, want in (("mcp__store__recall", True), ("mcp__x__get_file", True), ("mcp__x__Edit", False), ("recall", False)):
        assert one(spark, T.operational_tool(t), t=name) is want


def test_relative_days(spark):
    for text, want in (("It failed last night", -1), ("today and tomorrow", 0), ("due tomorrow", 1), ("next month", 30), ("tonigt", 0), ("yesterday어제", None), ("nothing", None)):
        got = one(spark, timex.relative_day(F.col("t"), F.col("m")), t=text, m=NOW)
        assert got == (None if want is None else (NOW // timex.DAY_MS + want) * timex.DAY_MS), text
