import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mnestra.llm.bagminhash import first_points, near_duplicate_groups, near_duplicate_pairs

WORD = re.compile(r"[^\W_]+")


def brute(rows, t):
    rows = sorted({r for r in rows if r[1] is not None and r[2] is not None}, key=lambda r: r[1])
    out = set()
    for i, (f, a, x) in enumerate(rows):
        for g, b, y in rows[i + 1 :]:
            p, q = set(WORD.findall(x.lower())), set(WORD.findall(y.lower()))
            if f == g and a != b and (x == y or (p | q and len(p & q) / len(p | q) >= t)):
                out.add((f, min(a, b), max(a, b)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "a", "한글", "É"]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(1, 4)):
            words = [w if rng.random() > 0.08 else rng.choice(vocabulary) for w in base]
            rng.random() < 0.3 and rng.shuffle(words)
            rows.append((rng.choice(["text", "content"]), n, " ".join(words)))
            n += 1
    rows += [("text", n + i, x) for i, x in enumerate([None, "", "", "!!", "ok", "OK.", "ok", "lorem " * 20_000, "lorem"])]
    rows.append(rows[0])
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 256), (2, 3)])
def test_pairs_equal_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "field_name string, id long, value string").selectExpr("*", "1 as kind", "2 as bucket")
    got = [tuple(r) for r in near_duplicate_pairs(df, 0.7, hot_bucket=hot).collect()]
    want = brute(rows, 0.7)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.98 * len(want)


def test_groups(spark):
    rows = [("text", 1, "a b c d e f g h i j"), ("text", 2, "a b c d e f g h i x"), ("text", 3, "a b c d e f g h y x"), ("text", 4, "q r s"), ("text", 5, "q r s"), ("content", 6, "q r s")]
    got = {r["id"]: (r["group_id"], r["links"]) for r in near_duplicate_groups(spark.createDataFrame(rows, "field_name string, id long, value string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (4, 0), 5: (4, 0), 6: (6, 0)}


def test_empty(spark):
    assert near_duplicate_pairs(spark.createDataFrame([], "field_name string, id long, value string")).collect() == []


def test_registers_agree_as_often_as_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(5)
    words = rng.integers(-(2**62), 2**62, 12)
    one, two = np.array([0, 1, 2, 3] * 3), np.array([0, 2, 1, 3] * 3)
    a, b = (first_points(words, level, np.arange(20_000)).min(axis=0) for level in (one, two))
    expected = np.minimum(2.0**one, 2.0**two).sum() / np.maximum(2.0**one, 2.0**two).sum()
    assert abs((a == b).mean() - expected) < 0.02


@pytest.mark.parametrize("hot_word", [4096, 3])
def test_boilerplate_in_a_third_of_all_rows_hides_no_pair(spark, hot_word):
    rng = random.Random(11)
    template, word = " ".join(f"t{i}" for i in range(12)), iter(range(10**6))
    rare = lambda n: [f"r{next(word)}" for _ in range(n)]
    rows = []
    for n in range(150):  # 14 of 20 words in common
        shared = rare(2)
        rows += [("text", 6 * n + i, " ".join([template, *shared, *rare(3)])) for i in (0, 1)]
        rows += [("text", 6 * n + i, " ".join([f"w{rng.randint(0, 60)}" for _ in range(8)] + rare(4))) for i in (2, 3, 4, 5)]
    rows += [("text", 10_000 + i, x) for i, x in enumerate(["t0", "T0", "t0 t1", "t1 t0", "t1", template, template + " t0."])]
    got = [tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, "field_name string, id long, value string"), 0.7, hot_word=hot_word).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7) and len(got) > 150


@pytest.mark.parametrize("long_key", [100_000, 40])
def test_long_runs_of_one_key_are_met_whole(spark, long_key):
    rows = [("text", n, f"a b c d e f g {'xyzuvw'[n % 6]} n{n} m{n % 50}") for n in range(700)]
    got = {tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, "field_name string, id long, value string"), 0.7, long_key=long_key).collect()}
    assert got == brute(rows, 0.7) and got


def test_repeated_words_count_in_multisets(spark):
    rows = [("text", 1, "go go go stop"), ("text", 2, "go go go go stop"), ("text", 3, "go stop"), ("text", 4, "go stop!")]
    df = spark.createDataFrame(rows, "field_name string, id long, value string")
    assert {tuple(r) for r in near_duplicate_pairs(df, 0.7, multiset=True).collect()} == {("text", 1, 2), ("text", 3, 4)}
    assert len(near_duplicate_pairs(df, 0.7).collect()) == 6


def brute_by_words(rows, t):
    """``brute`` for many records: only those that share a word are compared."""
    words = {n: set(WORD.findall(x.lower())) for _, n, x in rows}
    holders = {}
    for n, w in words.items():
        for x in w:
            holders.setdefault(x, set()).add(n)
    return {("text", a, b) for a, w in words.items() for b in set().union(*[holders[x] for x in w if x[0] == "n"]) if a < b and len(w & words[b]) / len(w | words[b]) >= t}


def frequent_names(records):
    """Records of 16 words: a template's four, and twelve of 80 names, so that every name stands in a seventh of all records."""
    rng = random.Random(3)
    rows = []
    for n in range(records):
        names = rng.sample([f"n{i}" for i in range(80)], 12)
        rows.append(("text", 2 * n, " ".join(["the", "of", "in", "is", *names])))
        if n % 9 == 0:
            rows.append(("text", 2 * n + 1, " ".join(["the", "of", "at", "is", *names[:11], f"n{n % 80}"])))
    return rows


@pytest.mark.parametrize("hot_word,long_key", [(4096, 100_000), (3, 100_000), (4096, 90)])
def test_records_with_many_frequent_names(spark, hot_word, long_key):
    rows = frequent_names(700)
    df = spark.createDataFrame(rows, "field_name string, id long, value string")
    got = [tuple(r) for r in near_duplicate_pairs(df, 0.7, hot_word=hot_word, long_key=long_key).collect()]
    want = brute_by_words(rows, 0.7)
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 70


def test_small_and_large_sets_of_a_low_threshold_meet(spark):
    rng = random.Random(8)
    rows = [("text", n, " ".join(rng.sample([f"n{i}" for i in range(40)], rng.choice([1, 2, 3, 4, 7])))) for n in range(250)]
    rows += [("text", 1000 + n, " ".join(f"n{i}" for i in range(n, n + size))) for n, size in enumerate([255, 256, 257, 258, 300, 600, 200, 180])]
    df = spark.createDataFrame(rows, "field_name string, id long, value string")
    for t in (0.3, 0.7):
        assert {tuple(r) for r in near_duplicate_pairs(df, t, bands=1).collect()} == brute(rows, t)


def test_frequent_words_are_met_without_the_square_of_their_records(spark, monkeypatch):
    """The runs of frequent words are not compared whole: pairs looked at stay far below those that share a word."""
    from mnestra.llm import bagminhash

    looked, of_runs = [], bagminhash._pairs_of_runs

    def counted(*args):
        for i, j in of_runs(*args):
            looked.append(len(i))
            yield i, j

    class Rows:  # stands for a DataFrame: runs the steps here
        columns = ["key", "kind", "place", *bagminhash._PARITY, "rest"]

        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, f, schema):  # noqa: N802
            return list(f(iter(self.batches)))

    monkeypatch.setattr(bagminhash, "_pairs_of_runs", counted)
    rng = np.random.default_rng(2)
    words = [np.sort(rng.choice(400, 20, replace=False)) for _ in range(3000)]
    words += [np.sort(np.append(w[:19], 401)) for w in words[:100]]
    sets = pa.RecordBatch.from_arrays([pa.array(range(len(words))), pa.array([7] * len(words)), pa.array([w.tolist() for w in words], pa.list_(pa.int64()))], names=["kind", "field", "words"])
    often = type("Often", (), {"value": np.full(bagminhash._CELLS, 150)})
    keys = pa.Table.from_batches(bagminhash._prefix_keys(Rows([sets]), often, 0.7, 4096)).sort_by([("key", "ascending"), ("kind", "ascending")])
    (keys,) = keys.combine_chunks().to_batches()
    met = pa.Table.from_batches(bagminhash._meet_exactly(Rows([keys.slice(n, 500) for n in range(0, len(keys), 500)]), 0.7, None))
    assert {(n, 3000 + n) for n in range(100)} <= set(zip(met["a"].to_pylist(), met["b"].to_pylist()))
    lengths = np.unique(keys["key"].to_numpy(), return_counts=True)[1]
    assert sum(looked) < 0.2 * (lengths * (lengths - 1) // 2).sum()
