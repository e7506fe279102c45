import random

import numpy as np
from pyspark.sql import functions as F

from mnestra.llm.mixing import mix_report, mix_sources, rake

TARGETS = [("Big", 0.5, 1), ("mid ", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3), (None, 0.1, 1), ("off", 0.0, 1)]


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        source = rng.choices(["big", " BIG", "mid", "small", None, "other", "off"], [50, 5, 20, 3, 2, 5, 2])[0]
        rows.append((i, "word " * rng.randint(1, 120), rng.choice(["en", "ko", None]), source, rng.choice(["a::x", "b::y", None])))
    return rows + [(9000, None, "en", "big", "a::x"), (9001, "", "en", "big", "a::x"), rows[0], rows[0]]


def test_shares_are_reached_within_the_repeats_allowed(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, bank_id string").selectExpr("*", "1 as row", "2 as tokens", "3 as part")
    mixed = mix_sources(df, TARGETS)
    report = {r["source"]: r for r in mix_report(mixed, TARGETS).collect()}
    assert set(report) == {"big", "mid", "small", "absent"}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(report[s]["reached_share"] - share / 0.95) < 0.01
        assert report[s]["most_copies"] <= report[s]["max_repeats"]
    assert report["absent"]["tokens"] == 0
    assert report["small"]["most_copies"] == 4  # the scarcest source is used up, so the mix is the largest possible
    less = mix_sources(df, TARGETS, total_tokens=5000).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert abs(less - 5000) < 500


def test_every_language_is_a_marginal_of_its_own(spark):
    rows = [(i, "word " * (1 + i % 9), f"l{i % 20}" if i % 21 else None, "big" if i % 2 else "mid", f"t{i % 3}::x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bank_id string")
    mixed = mix_sources(df, [("big", 0.5, 1), ("mid", 0.5, 1)], total_tokens=4000)
    langs = spark.createDataFrame([(r[0], r[2] or "-") for r in rows], "doc_id long, lang string")
    taken = {r["lang"]: r["n"] for r in mixed.join(langs, "doc_id").groupBy("lang").agg(F.sum("tokens").alias("n")).collect()}
    assert len(taken) == 21 and max(taken.values()) < 2 * min(taken.values())


def test_order_of_rows_does_not_matter(spark):
    rows = corpus()[:800]
    df = lambda r, n: spark.createDataFrame(r, "doc_id long, text string, lang string, source string, bank_id string").repartition(n)
    one, two = (sorted(map(tuple, mix_sources(df(r, n), TARGETS).collect())) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one == two and one


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, bank_id string")
    assert mix_sources(df, TARGETS).collect() == [] and mix_sources(df, []).collect() == []
    assert {r["reached_share"] for r in mix_report(mix_sources(df, TARGETS), TARGETS).collect()} == {0.0}


def test_marginals_are_raked():
    rng = np.random.default_rng(3)
    cells = [{"source": s, "lang": l, "topic": t, "tokens": int(rng.integers(100, 5000))} for s in "ab" for l in range(3) for t in range(2)]
    weight, size = rake(cells, {"a": 0.7, "b": 0.3}, {"a": 3, "b": 5}, total_tokens=9000)
    tokens = np.array([c["tokens"] for c in cells])
    taken = weight * tokens
    assert abs(size - 9000) < 1e-6 and abs(taken.sum() - 9000) < 1e-6
    assert abs(taken[[c["source"] == "a" for c in cells]].sum() - 6300) < 1e-6
    for lang in range(3):
        mine = np.array([c["lang"] == lang for c in cells])
        assert abs(taken[mine].sum() / 9000 - tokens[mine].sum() / tokens.sum()) < 0.005
