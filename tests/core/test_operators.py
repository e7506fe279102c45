import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mnestra.operators import curation as C
from mnestra.operators import entities as E
from mnestra.operators import graph as G
from mnestra.operators import ingest as I
from mnestra.operators import metrics as M
from mnestra.operators import retrieval as R
from mnestra.operators import store as S
from mnestra.operators import verify as V
from mnestra.operators.components import connected_components

DAY = 86_400_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def value(spark, column, **v):
    types = {str: "string", int: "long", float: "double", list: "array<string>", dict: "map<string,string>", bool: "boolean"}
    schema = ", ".join(f"{k} {types.get(type(x), 'long')}" for k, x in v.items()) or "z int"
    return spark.createDataFrame([tuple(v.values()) or (0,)], schema).select(column.alias("x")).first()["x"]


def test_fusion_adds_reciprocal_ranks_and_breaks_ties_by_arm(spark):
    arm = lambda ids: spark.createDataFrame([(1, n, i + 1, 0.5) for i, n in enumerate(ids)], "qid long, node_id long, rank int, score double")
    got = {r["node_id"]: (r["rrf"], r["rrf_rank"]) for r in R.fuse({"semantic": arm([1, 2]), "bm25": arm([2, 3])}).collect()}
    assert got[2] == (round(1 / 62 + 1 / 61, 9), 1)
    assert got[1] == (round(1 / 61, 9), 2) and got[3] == (round(1 / 62, 9), 3)
    tie = {r["node_id"]: r["rrf_rank"] for r in R.fuse({"bm25": arm([7]), "temporal": arm([4])}).collect()}
    assert tie == {7: 1, 4: 2}
    capped = R.fuse({"semantic": arm([1, 2, 3])}, cap_per_source=1)
    assert rows(capped, "node_id") == [(1,)]


def test_boosts(spark):
    now = 2_000_000_000_000
    for age, want in ((0, 1.0), (182.5, 0.5), (365, 0.1), (400, 0.1)):
        assert abs(value(spark, R.recency(F.col("a"), now), a=int(now - age * DAY)) - want) < 1e-9
    assert value(spark, R.recency(F.lit(None).cast("long"), now)) == 0.5
    near = lambda at, lo, hi: value(spark, R.proximity(F.col("a"), F.col("l"), F.col("h")), a=at, l=lo, h=hi)
    assert near(5, 0, 10) == 1.0 and near(0, 0, 10) == 0.0 and near(20, 0, 10) == 0.0 and near(5, 5, 5) == 1.0 and near(5, 9, 1) == 0.5
    for n, want in ((1, 0.5), (3, 0.5 + math.log(3) / 10), (149, 1.0), (0, 0.5)):
        assert abs(value(spark, R.proof(F.col("n")), n=n) - want) < 1e-3


def test_tag_modes(spark):
    for tags, wanted, mode, want in (
        (["a"], ["a", "b"], "any", True), (["a"], ["a", "b"], "all", False), (["a", "b"], ["a", "b"], "all", True), ([], ["a"], "any", True), ([], ["a"], "all_strict", False),
        ([], ["a"], "any_strict", False), (["c"], ["a"], "any_strict", False), (["c"], [], "all_strict", True),
    ):
        assert value(spark, R.tag_match(F.col("t"), wanted, mode), t=tags) is want


def test_restatements(spark):
    ranked = spark.createDataFrame([(1, n, i + 1, f"t{n}") for i, n in enumerate([10, 1, 2, 20, 3, 4])], "qid long, node_id long, final_rank int, text string")
    sources = spark.createDataFrame([(10, 1), (10, 2), (20, 3), (20, 1), (30, 4), (20, 99)], "observation_id long, source_id long")
    assert rows(R.drop_restatements(ranked, sources), "node_id") == [(3,), (4,), (10,)]
    same = spark.createDataFrame([(1, 1, 1, "a  b"), (1, 2, 2, " a b"), (2, 2, 1, "a b"), (1, 3, 3, None), (1, 4, 4, "")], "qid long, node_id long, final_rank int, text string")
    assert rows(R.drop_same_texts(same), "qid", "node_id") == [(1, 1), (1, 3), (1, 4), (2, 2)]


def test_token_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1), (2, 1, 50), (2, 2, 1)], "qid long, final_rank int, tokens int")
    assert rows(R.within_tokens(df, 10), "qid", "final_rank") == [(1, 1)]


def test_params_are_checked():
    assert R.RecallParams(limit=900).checked().limit == 200 and R.RecallParams(limit=900).checked().fetch == 1000
    for wrong in ({"types": ()}, {"budget": "huge"}, {"max_tokens": 0}, {"tags": ("x",) * 33}, {"tag_mode": "some"}, {"preamble": "x" * 5000}):
        with pytest.raises(ValueError):
            R.RecallParams(**wrong).checked()


def store(spark, n=40):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    nodes = [(i, "b1" if i % 3 else "b2", ["world", "experience", "observation"][i % 3], " ".join(rng.choice(words) for _ in range(6)), None, i * DAY, None, i * DAY + 5, i % 4, None) for i in range(n)]
    nodes += [(n, "b1", "world", None, None, None, None, None, None, None), (n + 1, "b1", "world", "", "", None, None, None, 0, None)]
    df = spark.createDataFrame(nodes, "id long, bank_id string, fact_type string, text string, context string, occurred_start long, occurred_end long, mentioned_at long, proof_count long, event_date long")
    vectors = spark.createDataFrame([(i, "b1" if i % 3 else "b2", [rng.gauss(0, 1) for _ in range(4)], "m") for i in range(0, n, 2)] + [(1, "b1", None, "m"), (3, "b1", [0.0] * 4, "m"), (5, "b1", [1.0], "m")], "node_id long, bank_id string, embedding array<float>, embedding_model string")
    links = spark.createDataFrame([(i, i + 3, "semantic", 0.5 + i / 100) for i in range(n - 3)], "from_node_id long, to_node_id long, link_type string, weight double")
    entities = spark.createDataFrame([(1, "b1", 3), (2, "b1", 500)], "id long, bank_id string, mention_count long")
    members = spark.createDataFrame([(1, 1), (4, 1), (1, 2), (7, 2)], "node_id long, entity_id long")
    tags = spark.createDataFrame([(1, "x"), (4, "x"), (4, "y")], "node_id long, tag string")
    sources = spark.createDataFrame([(2, 1), (5, 4)], "observation_id long, source_id long")
    return R.Store(df, vectors, links, entities, members, tags, sources)


def test_recall_end_to_end(spark):
    s = store(spark)
    asked = spark.createDataFrame([(1, "b1", "alpha beta gamma", [1.0, 0.0, 0.0, 0.0], 0, 9 * DAY), (2, "b2", "zeta", None, None, None), (3, "b1", "ab", [1.0, 0.0, 0.0, 0.0], None, None), (4, "nobody", "alpha beta", None, None, None)], "qid long, bank_id string, text string, vector array<float>, first_ms long, last_ms long")
    got = R.recall(asked, s, R.RecallParams(now_ms=100 * DAY, limit=5)).collect()
    assert {r["qid"] for r in got} <= {1, 2} and any(r["qid"] == 1 for r in got)
    for q in {r["qid"] for r in got}:
        mine = sorted((r for r in got if r["qid"] == q), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) <= 5
        assert all(a["final"] >= b["final"] for a, b in zip(mine, mine[1:]))
    tagged = R.recall(asked, s, R.RecallParams(now_ms=100 * DAY, tags=("x",), tag_mode="all_strict")).collect()
    assert {r["node_id"] for r in tagged} <= {1, 4}
    text = R.render(R.recall(asked, s, R.RecallParams(now_ms=100 * DAY)), 100 * DAY).filter("qid = 1").first()["injected_text"]
    assert text.startswith("<memories>\n\nCurrent time - 1970-04-11 00:00 UTC\n\n- ") and text.endswith("</memories>")
    empty = R.recall(asked.filter("false"), s)
    assert empty.collect() == []


def test_reranker_replaces_the_base_of_the_best(spark):
    df = spark.createDataFrame([(1, i, i, 10 - i, "q", f"t{i}", "", 0, 0) for i in range(1, 5)], "qid long, node_id long, rrf_rank int, s int, query_text string, text string, context string, occurred_start long, mentioned_at long").withColumn("base", F.lit(None).cast("double"))
    out = R.rerank(df, lambda q, d: F.length(d).cast("double") * 0, top_k=2)
    assert rows(out, "node_id", "base") == [(1, 0.5), (2, 0.5)]
    assert R.rerank(df, lambda q, d: F.lit(None).cast("double"), top_k=2).count() == 4


def test_graph_arm_scores(spark):
    s = store(spark)
    links = spark.createDataFrame([(1, 4, "caused_by", 0.5), (4, 1, "semantic", 0.8), (1, 3, "semantic", 0.9)], "from_node_id long, to_node_id long, link_type string, weight double")
    seeds = spark.createDataFrame([(9, "b1", 1)], "qid long, bank_id string, node_id long")
    got = rows(R.graph_arm(seeds, R.Store(s.nodes, None, links, s.entities, s.node_entities)), "node_id", "score")
    assert got == [(4, round(math.tanh(0.5) + 1.3, 6))]  # 3 is of another bank; entity 2 is too common for 7


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_temporal_links_equal_the_whole_band(spark, seed):
    rng = random.Random(seed)
    span = [3 * DAY, 40 * DAY, 400 * DAY][seed - 1]
    nodes = [(i, "b", rng.choice(["w", "e"]), rng.randrange(span) if rng.random() < 0.9 else 3_600_000 * rng.randrange(30)) for i in range(400)] + [(1000, "b", "w", None)]
    got = rows(G.temporal_links(spark.createDataFrame(nodes, "id long, bank_id string, fact_type string, event_date long"), 5), "from_node_id", "to_node_id", "weight")
    want = []
    for i, _, kind, at in nodes:
        if at is None:
            continue
        near = [(-max(0.3, 1 - abs(at - b) / DAY), j) for j, _, k, b in nodes if b is not None and k == kind and j != i and abs(at - b) <= DAY]
        want += [(i, j, round(-w, 6)) for w, j in sorted(near)[:5]]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src long, dst long")), "node", "component"))
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    grouped = [(g * 1000 + a, g * 1000 + b, g) for g in (1, 2, None) for a, b in ((1, 2), (2, 3), (5, 4), (7, 7)) if g] + [(1, 2, None), (None, 3, None)]
    df = spark.createDataFrame(grouped, "src long, dst long, g long")
    want = {g * 1000 + n: g * 1000 + c for g in (1, 2) for n, c in ((1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7))} | {1: 1, 2: 1}
    for most in (500_000, 1):  # in one task a group, and by rounds
        assert dict(rows(connected_components(df, group="g", group_edges=most), "node", "component")) == want
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long"), max_rounds=1)


def test_histogram_quantiles(spark):
    df = spark.createDataFrame([("a", x) for x in (50, 90, 200, 240, 9_000_000)], "k string, us long")
    q = M.histogram_quantiles(M.histogram(df, ["k"], "us"), ["k"]).first()
    assert q["n"] == 5 and q["most"] == 9_000_000 and q["p50"] == 300.0 and q["p99"] == 9_000_000.0
    assert M.histogram_quantiles(M.histogram(df.filter("false"), ["k"], "us"), ["k"]).collect() == []
    assert value(spark, M.bucket(F.col("x")), x=100) == 0 and value(spark, M.bucket(F.col("x")), x=101) == 1 and value(spark, M.bucket(F.col("x")), x=500_001) == 19
    edge = spark.createDataFrame([("a", x) for x in (34_999, 35_000, 35_001, 60_000, None)], "k string, us long")
    assert rows(M.under_limits(edge, ["k"], "us"), "under_35000", "under_60000") == [(2, 4)]


def test_macro_average(spark):
    per = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.5)], "qid long, mrr double")
    strata = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "qid long, stratum string")
    assert rows(M.macro_average(per, strata), "stratum", "queries", "excluded", "mrr") == [("a", 2, 0, 0.5), ("all", 3, 1, 0.5), ("b", 1, 1, 0.5)]


def test_chunks():
    rng = random.Random(3)
    turns = [{"role": "user", "content": "x" * rng.randint(1, 80)} for _ in range(40)]
    texts = ["short", "a" * 1000, "One. Two! Three? " * 60, "p\n\n" * 300, json.dumps(turns), "\n".join(json.dumps(t) for t in turns), json.dumps({"k": "v w " * 300}), "\n \n" * 500, "é한 " * 400, json.dumps([{"k": "z" * 500}, {"a": 1}])]
    for text in texts:
        for most in (50, 200):
            parts = I.chunk_text(text, most)
            assert parts and (len(parts) == 1 or all(len(p) <= most for p in parts))
            assert [q for p in parts for q in I.chunk_text(p, most)] == parts
            if text.strip():
                assert "".join("".join(parts).split()).replace(",", "") == "".join(text.split()).replace(",", "").replace("][", "") or text[0] in "[{"
    packed = I.chunk_text(json.dumps(turns), 200)
    assert [t for p in packed for t in json.loads(p)] == turns
    assert I.chunk_text(None) == []


def test_tool_input_and_files(spark):
    short = value(spark, I.compact_tool_input(F.col("m")), m={"command": "x" * 310, "b": "y"})
    assert short["command"] == "x" * 300 + "... (+10 chars)" and short["b"] == "y"
    long = value(spark, I.compact_tool_input(F.col("m")), m={"command": "ls", **{f"k{i}": "v" * 299 for i in range(9)}})
    assert set(long) == {"command", "_truncated_fields"} and json.loads(long["_truncated_fields"]) == [f"k{i}" for i in range(9)]
    calls = [("s", 1, 0, "assistant", "Edit", "/w/a.py", None, "/w"), ("s", 1, 1, "assistant", "mcp__x__Write", "/w/b.py", None, "/w"), ("s", 2, 0, "assistant", "Edit", "/w/a.py", None, "/w"), ("s", 3, 0, "user", "Edit", "/w/c.py", None, "/w"), ("s", 4, 0, "assistant", "Read", "/w/d.py", None, "/w"), ("s", 5, 0, "assistant", "NotebookEdit", " ", "/o/e.nb", "/w"), ("s", 6, 0, "assistant", "Edit", "bad\npath", None, "")]
    df = spark.createDataFrame(calls, "session_id string, turn int, nth int, role string, name string, file_path string, notebook_path string, cwd string")
    assert I.touched_files(df).first()["files"] == ["a.py", "b.py", "/o/e.nb"]


def test_content_blocks_of_logs_are_parsed_and_capped(spark):
    call = lambda name, **given: {"type": "tool_use", "name": name, "input": given}
    entry = lambda role, content: json.dumps({"type": role, "message": {"role": role, "content": content}})
    lines = [
        entry("user", "<memories>x</memories> <channel id='1'> hi </channel>"),
        entry("assistant", [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": " ok "}, call("mcp__m__recall", query="q"), call("Write", file_path="/w/a.py", content="word " * 100, n=3)]),
        entry("user", [{"type": "tool_result", "tool_use_id": "u", "content": [{"type": "text", "text": "r " * 2000}, {"type": "image"}]}, call("Write", file_path="/w/no.py"), "stray"]),
        json.dumps({"role": "user", "content": '[{"type": "text"}]'}),
        json.dumps({"type": "system", "subtype": "compact_boundary"}),
        "not json",
    ]
    df = spark.createDataFrame([("s", n, x) for n, x in enumerate(lines)], "session_id string, turn int, value string")
    got = {r["turn"]: json.loads(r["blocks"])["content"] for r in I.message_blocks(df).collect()}
    text = lambda x: {"type": "text", "text": x}
    written = ("word " * 100)[:300] + "... (+200 chars)"
    result = ("r " * 2000).strip()[:2000] + "... (truncated)"
    assert got == {0: [text("hi")], 1: [text("ok"), call("Write", file_path="/w/a.py", content=written, n=3)], 2: [{"type": "tool_result", "tool_use_id": "u", "content": result}], 3: [text('[{"type": "text"}]')]}
    plan = I.plan_sessions(df, "/w").first()
    assert plan["files"] == ["a.py"] and plan["messages"] == 4 and plan["raw_tokens"] > plan["capped_tokens"] and len(json.loads(plan["transcript"])) == 4


def test_facts_are_parsed_and_renumbered(spark):
    reply = json.dumps({"facts": [{"what": "..."}, {"what": "A", "when": "N/A", "who": "me", "why": "because", "fact_type": "assistant"}, {"text": "B yesterday", "fact_kind": "event", "entities": ["e"] * 40, "causal_relations": [{"target_index": 0, "relation_type": "caused_by"}, {"target_index": 1, "relation_type": "caused_by"}, {"target_index": 2, "relation_type": "caused_by"}]}, {"what": "x" * 2001}]})
    df = spark.createDataFrame([("r1", reply, 10 * DAY), ("r2", "not json", 0), ("r3", "[]", 0), ("r4", json.dumps([{"what": "C"}]), None), ("r5", None, None)], "reply_id string, reply string, event_ms long")
    got = {(r["reply_id"], r["fact_index"]): r for r in I.parse_facts(df).collect()}
    assert set(got) == {("r1", 0), ("r1", 1), ("r4", 0)}
    a, b = got["r1", 0], got["r1", 1]
    assert a["text"] == "A | Involving: me | because" and a["fact_type"] == "experience" and a["occurred_start"] is None
    assert b["text"] == "B yesterday" and b["occurred_start"] == "1970-01-10T00:00:00Z" == b["occurred_end"] and len(b["entities"]) == 32
    assert [r["target_index"] for r in b["causes"]] == [0]


def test_entity_resolution(spark):
    known = [(1, "b", "Ollama Server", ["gpu"], 5 * DAY), (2, "b", "ce-1", [], 5 * DAY), (3, "b", "ollama servers", ["gpu"], 9 * DAY), (4, "c", "olama server", None, None)]
    asked = [("m1", "b", " ollama server", [], 0), ("m2", "b", "olama server", ["gpu"], 9 * DAY), ("m3", "b", "ce-4", [], 5 * DAY), ("m4", "b", "unrelated", None, 0), ("m5", "c", "ce-1", [], 0), ("m6", "b", "  ", [], 0)]
    df = E.resolve(spark.createDataFrame(asked, "mention_id string, bank_id string, name string, nearby array<string>, at long"), spark.createDataFrame(known, "id long, bank_id string, canonical_name string, cooccurring array<string>, last_seen long"))
    assert {r["mention_id"]: (r["entity_id"], r["how"]) for r in df.collect()} == {"m1": (1, "exact"), "m2": (3, "similar"), "m3": (None, "new"), "m4": (None, "new"), "m5": (None, "new")}


def test_temporal_links_are_compared_both_ways(spark):
    nodes = [(1, "b", "world", 0, "a"), (2, "b", "world", 1000, "a"), (3, "b", "world", 9 * DAY, "a"), (4, "b", "world", 0, None)]
    links = [(1, 2, "temporal"), (1, 3, "temporal"), (1, 4, "temporal"), (3, 1, "caused_by")]
    got = V.temporal_differences(spark.createDataFrame(nodes, "id long, bank_id string, fact_type string, event_date long, archive_id string"), spark.createDataFrame(links, "from_node_id long, to_node_id long, link_type string"))
    assert {tuple(r) for r in got.collect()} == {(1, 3, "extra"), (2, 1, "missing")}


def test_short_names_resolve_without_common_trigrams(spark):
    known = [(1, "b", "rob", ["gpu"], DAY), (2, "b", "김민서", ["gpu"], DAY), (3, "b", "ab", ["gpu"], DAY), (4, "b", "xyz", ["gpu"], DAY)]
    asked = [(n, "b", n, ["gpu"], DAY) for n in ("bob", "김민수", "ac", "pqr")]
    df = E.resolve(spark.createDataFrame(asked, "mention_id string, bank_id string, name string, nearby array<string>, at long"), spark.createDataFrame(known, "id long, bank_id string, canonical_name string, cooccurring array<string>, last_seen long"))
    assert {r["mention_id"]: r["entity_id"] for r in df.collect()} == {"bob": 1, "김민수": 2, "ac": 3, "pqr": None}


def test_name_ratio(spark):
    df = spark.createDataFrame([("ollama", "olama"), ("kitten", "sitting"), ("", "")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(E.name_ratio("a", "b")).collect()]
    assert got == [0.9091, 0.6154, 1.0]


def test_source_facts_stop_at_each_observation_and_at_the_whole(spark):
    data = [("t", 1, 10, 5, 4), ("t", 1, 10, 4, 4), ("t", 1, 10, 3, 1), ("t", 2, 11, 9, 3), ("t", 2, 11, 8, 9), ("t", 3, 12, 7, 2)]
    df = spark.createDataFrame(data, "batch_id string, place int, observation_id long, fact_id long, tokens int")
    assert rows(C.source_facts(df, 5, 8), "observation_id", "fact_id") == [(10, 5), (11, 9)]
    assert rows(C.source_facts(df, 100, 100), "fact_id") == [(3,), (4,), (5,), (7,), (8,), (9,)]


def test_plans_are_validated(spark):
    update = lambda i, ids=(1,), text="t", reason="r": {"observation_id": i, "text": text, "source_fact_ids": list(ids), "reason": reason}
    replies = [
        ("ok", json.dumps({"creates": [{"text": "n", "source_fact_ids": [1, 77], "reason": "r"}, {"text": " n ", "source_fact_ids": [1, 1], "reason": "r"}, {"text": "n", "source_fact_ids": [], "reason": "r"}, {"text": "", "source_fact_ids": [1], "reason": "r"}, {"text": "n", "source_fact_ids": [77], "reason": "r"}], "updates": [update(5), update(6, reason="")], "deletes": [{"observation_id": 5, "reason": "r"}, {"observation_id": 7, "reason": "r"}]})),
        ("twice", json.dumps({"updates": [update(5), update(5)]})),
        ("many", json.dumps({"deletes": [{"observation_id": i, "reason": "r"} for i in (5, 6, 7)]})),
        ("bad", "nonsense"),
        ("stranger", json.dumps({"updates": [update(99)], "deletes": [{"observation_id": 98, "reason": "r"}]})),
    ]
    names = [r[0] for r in replies]
    pooled = spark.createDataFrame([(n, i) for n in names for i in (5, 6, 7)], "batch_id string, observation_id long")
    facts = spark.createDataFrame([(n, 1) for n in names], "batch_id string, fact_id long")
    got = C.validate_plans(spark.createDataFrame(replies, "batch_id string, reply string"), pooled, facts)
    assert sorted((r["batch_id"], r["action"], r["observation_id"] or 0, r["source_fact_ids"], r["text"] or "") for r in got.collect()) == [("ok", "create", 0, [1], "n"), ("ok", "delete", 7, [], ""), ("ok", "update", 5, [1], "t")]


def test_curation_pieces(spark):
    facts = spark.createDataFrame([("a", i, 10) for i in range(3)] + [("b", 1, 90), ("c", 1, 5)], "batch_id string, place int, tokens int")
    assert rows(C.fitting_batches(facts, 5, 30), "batch_id", "place") == [("a.0", 0), ("a.1", 1), ("a.1", 2), ("c", 1)]
    obs = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0]), (3, "c", [1.0])], "id long, text string, embedding array<float>")
    new = C.apply_updates(obs, spark.createDataFrame([(1, "z"), (2, "b")], "observation_id long, text string"), spark.createDataFrame([(3,)], "observation_id long"))
    assert rows(new, "id", "text", "embedding") == [(1, "z", None), (2, "b", [1.0])]
    for action, text, want in (("merge", " m ", "m"), ("merge", " ", "old"), ("keep", "m", None), ("??", "m", None)):
        assert value(spark, C.decision(F.col("a"), F.col("t"), F.lit("old")), a=action, t=text) == want
    cited = spark.createDataFrame([([3, 1, 3, 9], [1, 2, 3])], "c array<long>, a array<long>").select(C.keep_citations(F.col("c"), F.col("a")).alias("x")).first()["x"]
    assert cited == [3, 1]
    items = spark.createDataFrame([("p", 1, 50), ("p", 2, 10), ("q", 1, 500)], "m string, place int, tokens int")
    assert rows(C.prefix_within(items, "m", "place", "tokens", 40, 100, 1), "m", "place") == [("p", 1), ("p", 2), ("q", 1)]


def test_jobs_and_outcomes(spark):
    done = spark.createDataFrame([("a", True, 2, False), ("a", False, 0, False), ("b", False, 0, False), ("c", None, 0, False), ("d", None, 0, False), ("d", True, 0, False), ("e", True, 5, True), ("f", True, 0, None)], "job_id string, ok boolean, facts long, aborted boolean")
    assert rows(I.job_state(done), "job_id", "status") == [("a", "done"), ("b", "failed"), ("c", "pending"), ("d", "running"), ("e", "failed"), ("f", "done")]
    assert rows(I.fail_stale(I.job_state(done)), "job_id", "status")[2:4] == [("c", "failed"), ("d", "failed")]
    assert value(spark, I.mission(F.lit(""), F.lit("bank"), F.lit("profile"))) == "bank"
    bank = I.derive_bank(F.col("c"), F.col("a"), {"/w/x": "X", "/w": "W"})
    assert value(spark, bank, c="/w/x/deep", a="coder") == "X" and value(spark, bank, c="/wide/repo/", a="coder") == "coder::repo"
    assert value(spark, bank, c="/o/repo/worktrees/t1", a="coder") == "coder::repo"


def test_health_and_patch(spark):
    for db, embed, model, want in ((False, False, True, "UNHEALTHY"), (True, True, True, "DEGRADED"), (True, False, False, "DEGRADED"), (True, False, True, "HEALTHY")):
        assert value(spark, S.health(F.col("d"), F.col("e"), F.col("m")), d=db, e=embed, m=model) == want
    assert json.loads(value(spark, S.merge_metadata(F.col("m"), {"k": F.lit("v")}), m='{"a":"b","k":"old"}')) == {"a": "b", "k": "v"}
