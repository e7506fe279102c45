import itertools
import random
from collections import Counter

import pytest

from mnestra.llm.cooccurrence import cooccurrence


def brute(rows, least):
    baskets = {}
    for bank, doc, nth, names, *_ in rows:
        if bank is not None:
            baskets.setdefault((bank, doc, nth), set()).update(n.strip().lower() for n in names or [] if n is not None and n.strip())
    pairs, single, total = Counter(), Counter(), Counter()
    for (bank, _, _), names in baskets.items():
        total[bank] += 1
        single.update((bank, n) for n in names)
        pairs.update((bank, a, b) for a, b in itertools.combinations(sorted(names), 2))
    return {(b, x, y, n, single[b, x], single[b, y], total[b]) for (b, x, y), n in pairs.items() if n >= least}


@pytest.mark.parametrize("seed,chunk,least", [(1, 64, 2), (2, 3, 1), (3, 4, 2)])
def test_pairs_equal_brute_force(spark, seed, chunk, least):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)] + [" N1 ", "N2", "é", "\U0001f600", "￮"]
    rows = [(rng.choice(["a", "b", None]), rng.choice(["d1", "d2", None]), rng.randint(0, 30), rng.choices([*names, None, " "], k=rng.choice([0, 1, 2, 5, 20])), "x") for _ in range(150)]
    rows += [rows[0]] * 5 + [("a", "d9", 1, None, "x"), ("a", "d9", None, ["n1", "n2"], "x")]
    df = spark.createDataFrame(rows, "bank string, doc string, nth long, names array<string>, item string").selectExpr("*", "1 as n", "2 as grp")
    got = cooccurrence(df, "bank", ["doc", "nth"], "names", least, chunk).collect()
    assert {tuple(r)[:7] for r in got} == brute(rows, least)
    assert len(got) == len({tuple(r)[:3] for r in got})
    for r in got:
        assert abs(r["lift"] - r["together"] * r["baskets"] / (r["baskets_1"] * r["baskets_2"])) < 1e-9


def test_empty(spark):
    assert cooccurrence(spark.createDataFrame([], "bank string, doc string, names array<string>"), "bank", ["doc"], "names").collect() == []


def test_all_scores_hold_the_rare_pairs(spark, tmp_path):
    from mnestra.llm.queries import p2_all_scores

    rows = [("b", "d", n, ["x", "y"] if n < 6 else ["x", "z"]) for n in range(7)]
    spark.createDataFrame(rows, "bank_id string, document_id string, fact_index long, entities array<string>").write.parquet(f"{tmp_path}/archive_facts.parquet")
    got = {(r["item_1"], r["item_2"]): r["together"] for r in p2_all_scores(spark, str(tmp_path)).collect()}
    assert got == {("x", "y"): 6, ("x", "z"): 1}
