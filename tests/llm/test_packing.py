import random
from collections import defaultdict

from mnestra.llm.packing import Island, best_fit, completion, fill_report, lower_bound, pack_texts
from mnestra.llm.tokens import encoding, VOCABULARY


def check(rows, packed, limits):
    encode = encoding(VOCABULARY).encode_ordinary
    by = defaultdict(list)
    for r in packed:
        by[r["profile"]].append(r)
    for profile, capacity in limits:
        want, got = defaultdict(list), defaultdict(list)
        for doc, text in rows:
            n = None if text is None else len(encode(text))
            if n is None or n <= capacity:
                want[doc].append(n)
            else:
                want[doc] += [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])
        load = defaultdict(int)
        for r in by[profile]:
            got[r["doc_id"]].append(r["tokens"])
            assert (r["container_id"] is None) == (r["tokens"] is None)
            if r["container_id"] is not None:
                load[r["container_id"]] += r["tokens"]
        key = lambda v: (v is None, v)
        assert {d: sorted(v, key=key) for d, v in want.items()} == {d: sorted(v, key=key) for d, v in got.items()}
        assert all(v <= capacity for v in load.values())


def test_every_text_has_its_place(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha ", "of ", "Größe ", "기억 ", "x1 "])
    rows = [(i, "".join(word() for _ in range(rng.choice([1, 5, 30, 60, 200])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "b" * 50_000), (7, rows[7][1]), (7, rows[7][1]), (1003, " ")]
    limits = [("small", 64), ("large", 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item", "2 as tokens", "'x' as profile")
    packed = pack_texts(df, limits, block_items=50)
    check(rows, packed.collect(), limits)
    for r in fill_report(packed, limits).collect():
        assert r["filled"] > 0.93


def test_items_that_do_not_combine_end(spark):
    rows = [(i, "word " * 70) for i in range(120)]
    packed = pack_texts(spark.createDataFrame(rows, "doc_id long, text string"), [("p", 100)], block_items=30)
    check(rows, packed.collect(), [("p", 100)])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_texts(df, [("p", 10)]).collect() == [] and pack_texts(df, []).collect() == []


def test_genetic_search_beats_best_fit_decreasing():
    wins = 0
    for seed in range(10):
        rng = random.Random(seed)
        sizes = [rng.randint(20, 100) for _ in range(120)]
        island = Island(sizes, 150, seed)
        island.evolve(60, 10)
        plain = len(best_fit(sorted(range(120), key=lambda i: -sizes[i]), sizes, 150, []))
        bins, fills = island.best()
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert fills == [sum(sizes[i] for i in b) for b in bins] and max(fills) <= 150
        assert island.bound <= len(bins) <= plain
        wins += len(bins) < plain
    assert wins >= 3


def test_bound_and_completion():
    assert lower_bound([60, 60, 60, 10], 100) == 3 and lower_bound([50, 50, 50], 100) == 2 and lower_bound([], 10) == 0
    assert lower_bound([70, 70, 40, 40, 40], 100) == 4  # no 40 fits beside a 70
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.randint(0, 30) for _ in range(10)]
        taken = completion(50, list(range(10)), sizes)
        best = max(t for n in range(1024) if (t := sum(sizes[i] for i in range(10) if n >> i & 1)) <= 50)
        assert len(set(taken)) == len(taken) and sum(sizes[i] for i in taken) == best


def test_shipped_settings_save_containers():
    rng = random.Random(3)
    sizes = [min(512, int(rng.lognormvariate(5.3, 0.9))) for _ in range(2000)]
    island = Island(sizes, 512, 1)
    island.evolve(240, 4)
    plain = len(best_fit(sorted(range(2000), key=lambda i: -sizes[i]), sizes, 512, []))
    assert len(island.best()[0]) < plain or plain == island.bound


def test_order_of_rows_does_not_matter(spark):
    rows = [(i % 90, "word " * (i % 40 + 1)) for i in range(200)] + [(None, "a"), (None, "a")]
    df = lambda r, n: spark.createDataFrame(r, "doc_id long, text string").repartition(n)
    one, two = (sorted(map(tuple, pack_texts(df(r, n), [("p", 50)], block_items=60).collect()), key=str) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one == two and len(one) == len(rows)
