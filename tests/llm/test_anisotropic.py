import numpy as np

from mnestra.llm.anisotropic import encode, fit_centres, pack, parallel_weight, scan, similar_vectors


def brute(rows, k, t, dim):
    seen = {}
    for bank, node, v in rows:
        if bank is None or v is None or len(v) != dim or any(x is None for x in v):
            continue
        a = np.array(v, np.float32).astype(float)
        if np.isfinite(a).all() and a.any():
            seen[(bank, node)] = a / np.linalg.norm(a)
    out = set()
    for bank in {b for b, _ in seen}:
        ids = np.array([n for b, n in seen if b == bank])
        x = np.array([seen[(bank, n)] for n in ids])
        s = x @ x.T
        for i, node in enumerate(ids):
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
            out |= {(min(node, ids[j]), max(node, ids[j])) for j in order if s[i, j] >= t}
    return {(int(a), int(b)) for a, b in out}


def corpus(n, banks, dim, seed):
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(n // 4 + 1, dim))
    rows = []
    for i in range(n):
        v = bases[rng.integers(len(bases))] + rng.normal(size=dim) * rng.choice([0.2, 0.35])
        rows.append((f"b{int(banks * rng.random() ** 3)}", i, [float(x) for x in (v * rng.choice([1, 3])).astype(np.float32)]))
    return rows


def test_pairs_equal_brute_force(spark):
    dim = 64
    rows = corpus(900, 6, dim, 1)
    rows += [("b0", 5000 + i, rows[0][2]) for i in range(15)] + rows[:5]
    rows += [("b0", 6000, None), ("b0", 6001, [1.0] * 32), ("b0", 6002, [0.0] * dim), ("b0", 6003, [float("nan")] * dim), ("b0", 6004, [None] * dim), (None, 6005, rows[1][2])]
    df = spark.createDataFrame(rows, "bank_id string, node_id long, embedding array<float>").selectExpr("*", "1 as kind", "2 as side")
    got = {tuple(r) for r in similar_vectors(df).collect()}
    assert got == brute(rows, 10, 0.9, dim)


def test_leaves_and_split_leaves_reach_most_pairs(spark):
    rows = corpus(1500, 2, 64, 2)
    want = brute(rows, 10, 0.9, 64)
    df = spark.createDataFrame(rows, "bank_id string, node_id long, embedding array<float>")
    got = {tuple(r) for r in similar_vectors(df, large=200, leaf_rows=100, probes=4).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_empty(spark):
    assert similar_vectors(spark.createDataFrame([], "bank_id string, node_id long, embedding array<float>")).collect() == []


def test_the_loss_keeps_inner_products_of_close_pairs_better_than_plain_codes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    error = {}
    for eta in (1.0, parallel_weight(64, 0.2)):
        centres = fit_centres(x, eta)
        scores = scan(x[:300], pack(encode(x[:300], centres, eta)), centres)
        error[eta > 1] = np.abs(np.diag(scores) - 1).mean()
    assert error[True] < 0.6 * error[False]
