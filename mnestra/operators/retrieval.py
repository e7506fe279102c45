"""Batched hybrid retrieval: many queries over many banks in one job.

Every operator takes ``queries(qid, bank_id, ...)``.  Arms give (qid, node_id,
rank, score); ranks start at 1, and ties end with the node id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnestra.functions import text as T
from mnestra.functions.timex import DAY_MS, query_window
from mnestra.session import kept, materialise, spread

ARMS = ("semantic", "bm25", "graph", "temporal")
CAUSAL = ("caused_by", "causes", "enables", "prevents")
#: Candidates kept by budget, before the factor of two.
BUDGETS = {"low": 100, "mid": 300, "high": 1000}
K1, B = 1.2, 0.75
ENTITY_FAN_OUT = 200
EDGE_FETCH = 800


@dataclass(frozen=True)
class RecallParams:
    """Settings of a recall; out-of-range values raise or are clamped, as ``checked`` says."""

    types: tuple[str, ...] = ("world", "experience", "observation")
    tags: tuple[str, ...] = ()
    tag_mode: str = "any"
    limit: int = 20
    max_tokens: int = 1024
    semantic_alpha: float = 0.1
    cap_per_source: int = 0
    budget: str = "mid"
    min_query_chars: int = 5
    rrf_k: int = 60
    seeds: int = 20
    graph_cap: int = 200
    preamble: str = ""
    embedding_model: str | None = None
    now_ms: int = 1_767_225_600_000

    def checked(self) -> RecallParams:
        problems = []
        if not self.types:
            problems.append("types must not be empty")
        if self.budget not in BUDGETS:
            problems.append("budget must be low, mid or high")
        if not 1 <= self.max_tokens <= 8192:
            problems.append("max_tokens must be 1 to 8192")
        if len(self.tags) > 32:
            problems.append("at most 32 tags")
        if len(self.preamble.encode()) > 4096:
            problems.append("preamble is over 4 KB")
        if self.tag_mode not in ("any", "all", "any_strict", "all_strict"):
            problems.append("unknown tag mode")
        if problems:
            raise ValueError("; ".join(problems))
        return RecallParams(**{**self.__dict__, "limit": min(max(self.limit, 1), 200)})

    @property
    def fetch(self) -> int:
        """Rows of an arm: five for every result, so that later filters leave enough."""
        return min(max(5 * self.limit, 100), 1000)


@dataclass
class Store:
    """The tables that a recall reads."""

    nodes: DataFrame  # memory_nodes
    vectors: DataFrame | None = None  # node_id, bank_id, embedding, embedding_model
    links: DataFrame | None = None  # from_node_id, to_node_id, link_type, weight
    entities: DataFrame | None = None  # id, bank_id, mention_count
    node_entities: DataFrame | None = None  # node_id, entity_id
    tags: DataFrame | None = None  # node_id, tag
    sources: DataFrame | None = None  # observation_id, source_id
    index: TextIndex | None = None  # of the nodes' texts; built for a recall that is given none
    extra: dict = field(default_factory=dict)


def top(df: DataFrame, by: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """Number the rows of every group in an order, and keep the first ``k``."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def tag_match(tags: Column, wanted: list[str], mode: str = "any") -> Column:
    """Four modes: any or all of the tags; unless strict, rows without tags pass.  No tags wanted: all pass."""
    if not wanted:
        return F.lit(True)
    asked, held = F.array(*[F.lit(t) for t in wanted]), F.coalesce(tags, F.array().cast("array<string>"))
    hit = F.arrays_overlap(asked, held) if mode.startswith("any") else F.size(F.array_except(asked, held)) == 0
    return hit if mode.endswith("strict") else hit | (F.size(held) == 0)


def effective_ms(alias: str = "") -> Column:
    return F.coalesce(F.col(f"{alias}occurred_start"), F.col(f"{alias}mentioned_at"))


# --- arms -----------------------------------------------------------------------------------------


def postings(nodes: DataFrame) -> DataFrame:
    """(node_id, bank_id, fact_type, term, tf, doc_len); repeated terms are counted, the text is read once."""
    words = nodes.select(F.col("id").alias("node_id"), "bank_id", "fact_type", T.terms("text").alias("words"))
    flat = words.select("node_id", "bank_id", "fact_type", F.size("words").alias("doc_len"), F.explode("words").alias("term"))
    return flat.groupBy("node_id", "bank_id", "fact_type", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class TextIndex:
    """What full-text search reads: postings, the distinct terms, and one row of statistics."""

    postings: DataFrame  # node_id, bank_id, fact_type, term, tf, doc_len
    terms: DataFrame  # term
    stats: DataFrame  # n_docs, mean_len


def text_index(nodes: DataFrame, keep: str | None = None) -> TextIndex:
    """The index of the texts of nodes, written into the shared folder.

    With a name in ``keep`` it stays there for the session, and is read again for the same files.
    """
    read = nodes.filter(F.col("text").isNotNull()).select("id", "bank_id", "fact_type", "text")

    def build() -> DataFrame:
        return postings(spread(read))

    terms = kept(build, f"{keep}-postings", nodes) if keep else materialise(build(), "postings")
    vocabulary = kept(lambda: terms.select("term").distinct(), f"{keep}-terms", nodes) if keep else materialise(terms.select("term").distinct(), "terms")

    def counted() -> DataFrame:
        lengths = terms.select("node_id", "doc_len").distinct().agg(F.sum("doc_len").alias("all_len"))
        return read.agg(F.count(F.lit(1)).alias("n_docs")).join(F.broadcast(lengths)).select("n_docs", (F.coalesce("all_len", F.lit(0)) / F.col("n_docs")).alias("mean_len"))

    return TextIndex(terms, vocabulary, kept(counted, f"{keep}-stats", nodes) if keep else counted())


def bm25(queries: DataFrame, nodes: DataFrame, k: int, types: tuple[str, ...] | None = None, index: TextIndex | None = None) -> DataFrame:
    """Okapi BM25 over prefix terms joined by OR; lower is better, as the score is negated.

    Document counts and the mean length are those of all banks; the bank and type
    filters hold before the limit.  Prefixes are made only at the lengths that
    query terms have, so prefix matching is an equi-join.  Without an ``index`` one is built.
    """
    index = index or text_index(nodes)
    asked = queries.select("qid", "bank_id", F.explode(T.query_terms("text")).alias("term"))
    wanted = asked.select("term").distinct()
    lengths = [r[0] for r in wanted.select(F.length("term")).distinct().collect()]  # lengths of words
    prefixes = F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    # every distinct word is cut once, however many texts it stands in
    words = index.terms.select(F.col("term").alias("word")).select("word", F.explode(F.array_compact(prefixes)).alias("term")).join(wanted, "term", "left_semi")
    matched = index.postings.withColumnRenamed("term", "word").join(words, "word").groupBy("term", "node_id", "bank_id", "fact_type", "doc_len").agg(F.sum("tf").alias("tf"))
    df = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if types:
        matched = matched.filter(F.col("fact_type").isin(*types))
    hits = asked.join(matched, ["bank_id", "term"]).join(df, "term").join(F.broadcast(index.stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    scored = hits.groupBy("qid", "node_id").agg((-F.round(F.sum(part), 6)).alias("score"))
    return top(scored, ["qid"], [F.col("score"), F.col("node_id")], k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = 20_000, threshold: float | None = None, query_block: int = 4_000) -> DataFrame:
    """The ``k`` most similar vectors of the query's bank by cosine similarity (score, rounded to 6 digits).

    Exact: queries and vectors of a bank are cut into a grid of blocks of about ``query_block``
    by ``block`` rows, and every cell is a matrix product of its own, so neither side of a bank of any
    size comes into one task; only the best ``k`` of a cell move on.  Vectors of another length
    than the query's, or without length, are passed over.
    """
    parts = vectors.groupBy("bank_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("v_parts"))
    asked_parts = queries.groupBy("bank_id").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("q_parts"))
    grid = parts.join(asked_parts, "bank_id")  # a row a bank that is asked
    stored = vectors.select("bank_id", "node_id", "embedding").join(grid, "bank_id").withColumn("part", F.pmod(F.xxhash64("node_id"), F.col("v_parts")).cast("int"))
    stored = stored.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("bank_id", "node_id", "embedding", "row", "part")
    asked = queries.select("bank_id", "qid", "vector").join(grid, "bank_id").withColumn("row", F.pmod(F.xxhash64("qid"), F.col("q_parts")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1))).select("bank_id", "qid", "vector", "row", "part").toDF("q_bank", "qid", "vector", "q_row", "q_part")

    def scan(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": np.empty(0, np.int64), "node_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(q) or not len(v):
            return empty
        usable = lambda s: [i for i, x in enumerate(s) if x is not None and len(x)]
        q, v = q.iloc[usable(q["vector"])], v.iloc[usable(v["embedding"])].drop_duplicates("node_id")
        out = []
        for size in {len(x) for x in q["vector"]}:
            some, among = q[[len(x) == size for x in q["vector"]]], v[[len(x) == size for x in v["embedding"]]]
            if not len(among):
                continue
            unit = lambda s: (m := np.stack([np.asarray(x, np.float64) for x in s])) / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.nan)
            ids, stack = among["node_id"].to_numpy(), unit(among["embedding"])
            with np.errstate(invalid="ignore"):
                for lo in range(0, len(some), 512):
                    scores = np.round(unit(some["vector"].iloc[lo : lo + 512]) @ stack.T, 6)
                    scores[~np.isfinite(scores) | ((scores < threshold) if threshold is not None else False)] = -9.0
                    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -2.0)
                    by, near = np.nonzero((scores >= least[:, None]) & (scores > -2.0))
                    found = scores[by, near]
                    order = np.lexsort((ids[near], -found, by))
                    by, near, found = by[order], near[order], found[order]
                    best = np.arange(len(by)) - np.searchsorted(by, by) < k
                    out.append(pd.DataFrame({"qid": some["qid"].to_numpy()[lo:][by[best]], "node_id": ids[near[best]], "score": found[best]}))
        return pd.concat(out, ignore_index=True) if out else empty

    found = asked.groupBy("q_bank", "q_row", "q_part").cogroup(stored.groupBy("bank_id", "row", "part")).applyInPandas(scan, "qid long, node_id long, score double")
    return top(found, ["qid"], [F.desc("score"), F.col("node_id")], k)


def temporal_arm(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Nodes inside the query's window (both ends included), the newest first; the score is 0.

    The window is met through the days it covers, so this is an equi-join.
    """
    dated = nodes.select(F.col("id").alias("node_id"), "bank_id", effective_ms().alias("at")).filter("at is not null").withColumn("day", F.floor(F.col("at") / DAY_MS))
    day_of = lambda c: F.floor(F.col(c) / DAY_MS)
    asked = queries.filter("first_ms is not null and last_ms >= first_ms").select("qid", "bank_id", "first_ms", "last_ms", F.explode(F.sequence(day_of("first_ms"), day_of("last_ms"))).alias("day"))
    hits = asked.join(dated, ["bank_id", "day"]).filter("at between first_ms and last_ms")
    return top(hits.select("qid", "node_id", "at", F.lit(0.0).alias("score")), ["qid"], [F.desc("at"), F.col("node_id")], k).drop("at")


def graph_arm(seeds: DataFrame, store: Store, cap: int = 200) -> DataFrame:
    """One step from the seeds ``(qid, bank_id, node_id)``, by links both ways and by shared entities.

    The score is tanh(shared / 2) plus the best causal and the best other weight.
    Entities of more than 200 mentions lead nowhere.
    """
    seed = seeds.select("qid", "bank_id", F.col("node_id").alias("seed"))
    edges = store.links.select("from_node_id", "to_node_id", "link_type", "weight")
    both = edges.select(F.col("from_node_id").alias("seed"), F.col("to_node_id").alias("node_id"), "link_type", "weight").union(edges.select(F.col("to_node_id").alias("seed"), F.col("from_node_id").alias("node_id"), "link_type", "weight"))
    in_bank = store.nodes.select(F.col("id").alias("node_id"), "bank_id")
    not_seed = seed.select("qid", F.col("seed").alias("node_id"))
    stepped = seed.join(both, "seed").join(not_seed, ["qid", "node_id"], "left_anti").join(in_bank, ["node_id", "bank_id"], "left_semi")
    stepped = top(stepped, ["qid"], [F.desc("weight"), F.col("node_id"), F.col("link_type"), F.col("seed")], EDGE_FETCH, "nth")
    causal = F.col("link_type").isin(*CAUSAL)
    linked = stepped.groupBy("qid", "node_id").agg(F.max(F.when(causal, F.col("weight"))).alias("causal"), F.max(F.when(~causal, F.col("weight"))).alias("other"))
    narrow = store.entities.filter(F.col("mention_count") <= ENTITY_FAN_OUT).select(F.col("id").alias("entity_id"))
    member = materialise(store.node_entities.join(narrow, "entity_id", "left_semi").distinct(), "members")
    shared = seed.join(member.withColumnRenamed("node_id", "seed"), "seed").select("qid", "bank_id", "entity_id").distinct().join(member, "entity_id")
    shared = shared.join(not_seed, ["qid", "node_id"], "left_anti").join(in_bank, ["node_id", "bank_id"], "left_semi")
    shared = shared.groupBy("qid", "node_id").agg(F.countDistinct("entity_id").alias("shared"))
    shared = top(shared, ["qid"], [F.desc("shared"), F.col("node_id")], EDGE_FETCH, "nth").drop("nth")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.tanh(0.5 * zero("shared")) + zero("causal") + zero("other")
    scored = linked.join(shared, ["qid", "node_id"], "full_outer").select("qid", "node_id", F.round(score, 6).alias("score"))
    return top(scored, ["qid"], [F.desc("score"), F.col("node_id")], cap)


# --- fusion and scoring ---------------------------------------------------------------------------


def fuse(arms: dict[str, DataFrame], k: int = 60, cap_per_source: int = 0) -> DataFrame:
    """Reciprocal-rank fusion in the fixed order of arms; ties go to the first arm, then the better rank."""
    parts = []
    for i, name in enumerate(ARMS):
        if name in arms:
            part = arms[name].select("qid", "node_id", "rank", "score", F.lit(i).alias("arm"))
            parts.append(part.filter(F.col("rank") <= cap_per_source) if cap_per_source else part)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("qid", "node_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"),
        F.min(F.struct("arm", "rank")).alias("first"),
        F.max(F.when(F.col("arm") == 0, F.col("score"))).alias("semantic"),
        F.max(F.when(F.col("arm") == 1, F.col("score"))).alias("keyword"),
        F.sort_array(F.collect_set(F.element_at(F.array(*[F.lit(a) for a in ARMS]), F.col("arm") + 1))).alias("arms"),
    )
    return top(merged, ["qid"], [F.desc("rrf"), F.col("first"), F.col("node_id")], None, "rrf_rank").drop("first")


def recency(at: Column, now_ms: int) -> Column:
    return F.when(at.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), 1 - (F.lit(now_ms) - at) / float(DAY_MS) / 365)))


def proximity(at: Column, first: Column, last: Column) -> Column:
    """1 in the middle of the window, 0 at its edges and outside."""
    half = (last - first) / 2.0
    near = F.when(half > 0, F.greatest(F.lit(0.0), 1 - F.abs(at - (first + half)) / half)).otherwise(1.0)
    return F.when(at.isNull() | first.isNull() | last.isNull() | (last < first), 0.5).otherwise(near)


def proof(count: Column) -> Column:
    return F.when(count >= 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.log(count.cast("double")) / 10))).otherwise(0.5)


def score(candidates: DataFrame, now_ms: int, alpha: float = 0.1) -> DataFrame:
    """Final scores of candidates with node columns, ``rrf_rank``, ``base`` (or null) and ``first_ms, last_ms``."""
    per = Window.partitionBy("qid")
    rank0 = F.col("rrf_rank") - 1
    spread = F.max("semantic").over(per) - F.min("semantic").over(per)
    base = F.coalesce(F.col("base"), 1 - 0.9 * rank0 / F.greatest(F.count(F.lit(1)).over(per) - 1, F.lit(1)))
    semantic = F.when(F.col("semantic").isNull() | (spread <= 0), 0.5).otherwise((F.col("semantic") - F.min("semantic").over(per)) / spread)
    middle = F.floor((F.col("occurred_start") + F.col("occurred_end")) / 2)
    near = proximity(F.coalesce(middle, F.col("occurred_start"), F.col("occurred_end"), F.col("mentioned_at")), F.col("first_ms"), F.col("last_ms"))
    recent = recency(F.coalesce("occurred_start", "mentioned_at", "occurred_end"), now_ms)
    final = base * (1 + 0.2 * (recent - 0.5)) * (1 + 0.2 * (near - 0.5)) * (1 + 0.1 * (proof(F.col("proof_count")) - 0.5)) * (1 + alpha * (semantic - 0.5))
    scored = candidates.withColumn("final", F.round(final, 9))
    return top(scored, ["qid"], [F.desc("final"), F.col("rrf_rank")], None, "final_rank")


def drop_restatements(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """An observation above all its ranked sources replaces them; below one of them it goes itself."""
    place = ranked.select("qid", "node_id", "final_rank")
    pairs = place.join(sources.distinct(), F.col("node_id") == F.col("observation_id")).select("qid", "observation_id", "source_id", F.col("final_rank").alias("own"))
    met = pairs.join(place.select("qid", F.col("node_id").alias("source_id"), F.col("final_rank").alias("theirs")), ["qid", "source_id"])
    best = met.groupBy("qid", "observation_id", "own").agg(F.min("theirs").alias("best"))
    losers = best.filter("own > best").select("qid", F.col("observation_id").alias("node_id"))
    replaced = met.join(best.filter("own < best").select("qid", "observation_id"), ["qid", "observation_id"], "left_semi").select("qid", F.col("source_id").alias("node_id"))
    return ranked.join(losers.union(replaced).distinct(), ["qid", "node_id"], "left_anti")


def drop_same_texts(ranked: DataFrame) -> DataFrame:
    """Of texts that are equal but for white space, the best placed stays."""
    return top(ranked.withColumn("_same", T.collapse(F.col("text"))), ["qid", "_same"], [F.col("final_rank")], 1, "_nth").drop("_same", "_nth")


def within_tokens(ranked: DataFrame, max_tokens: int) -> DataFrame:
    """The longest run of best results whose sizes add up to at most ``max_tokens``."""
    order = Window.partitionBy("qid").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("total_tokens", F.sum("tokens").over(order)).filter(F.col("total_tokens") <= max_tokens)


def rerank(candidates: DataFrame, scorer, top_k: int = 10) -> DataFrame:
    """Replace the base score of the best ``top_k`` by a cross-encoder's, and drop the rest.

    ``scorer(query_text, document)`` is a column function (a pandas UDF); where it
    gives null the candidates of the query stay as they were.
    """
    document = F.concat_ws(" ", F.concat(F.lit("[Date: "), T.long_date(effective_ms()), F.lit(" ("), F.date_format(F.timestamp_millis(effective_ms()), "yyyy-MM-dd"), F.lit(")]")), F.when(F.col("context") != "", F.concat("context", F.lit(":"))), F.col("text"))
    logit = scorer(F.col("query_text"), document)
    scored = candidates.withColumn("_s", F.when(F.col("rrf_rank") <= top_k, F.coalesce(F.nanvl(1 / (1 + F.exp(-logit)), F.lit(0.0)), F.lit(None))))
    judged = scored.withColumn("_there", F.count("_s").over(Window.partitionBy("qid")) > 0)
    return judged.filter(~F.col("_there") | F.col("_s").isNotNull()).withColumn("base", F.when(F.col("_there"), F.col("_s"))).drop("_s", "_there")


def render(results: DataFrame, now_ms: int, tag: str = "memories", preamble: str = "") -> DataFrame:
    """(qid, injected_text): the results as lines of a tagged block that their texts cannot end.

    The block begins with the preamble and the time; a line ends with the time at which its fact was mentioned.
    """
    line = F.concat(F.lit("- "), T.defang(F.col("text"), tag), F.lit(" ["), F.col("fact_type"), F.lit("]"), F.coalesce(F.concat(F.lit(" ("), T.clock(F.col("mentioned_at")), F.lit(")")), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit(f"<{tag}>\n{preamble}\nCurrent time - "), T.clock(F.lit(now_ms)), F.lit("\n\n"))
    return results.groupBy("qid").agg(F.concat(head, F.array_join(lines, "\n\n"), F.lit(f"\n</{tag}>")).alias("injected_text"))


MAX_QUERY_BYTES = 8192


def rejected(queries: DataFrame, banks: DataFrame | None = None) -> DataFrame:
    """(qid, problem) of queries that are not answered: texts of over 8 KB, and banks that do not exist."""
    long = queries.filter(F.octet_length("text") > MAX_QUERY_BYTES).select("qid", F.lit("query too long").alias("problem"))
    if banks is None:
        return long
    unknown = queries.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_QUERY_BYTES).join(banks.select("bank_id").distinct(), "bank_id", "left_anti")
    return long.unionByName(unknown.select("qid", F.lit("unknown bank").alias("problem")))


def with_windows(queries: DataFrame, now_ms: int) -> DataFrame:
    """``queries`` with ``first_ms, last_ms``: what the text says about time; null where it says nothing or nothing that bounds it."""
    said = queries.withColumn("_w", query_window(F.col("text"), now_ms))
    return said.withColumns({"first_ms": F.col("_w.first_ms"), "last_ms": F.col("_w.last_ms")}).drop("_w")


def hydrate(ids: DataFrame, store: Store) -> DataFrame:
    """Rows of the nodes of ``ids(node_id)``, with sorted tags and sources."""
    rows = store.nodes.withColumnRenamed("id", "node_id").join(ids.select("node_id").distinct(), "node_id", "left_semi")
    if store.tags is not None:
        wanted = store.tags.join(ids.select("node_id").distinct(), "node_id", "left_semi")
        rows = rows.join(wanted.groupBy("node_id").agg(F.array_sort(F.collect_set("tag")).alias("tags")), "node_id", "left")
    if store.sources is not None:
        found = store.sources.groupBy(F.col("observation_id").alias("node_id")).agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
        rows = rows.join(found, "node_id", "left")
    return rows


def recall(queries: DataFrame, store: Store, params: RecallParams | None = None, scorer=None) -> DataFrame:
    """The whole pipeline: four arms, two fusions, scores, two deduplications, budgets.

    ``queries(qid, bank_id, text, vector)`` -> (qid, place,
    node_id, final, rrf, arms, tokens, total_tokens, text, fact_type, ...).
    A query's window of time is read from its text, unless columns ``first_ms, last_ms`` give it.
    Queries of fewer characters than ``min_query_chars`` have no results, nor have those that are ``rejected``.
    """
    p = (params or RecallParams()).checked()
    queries = queries.filter((F.length(F.trim("text")) >= p.min_query_chars) & (F.octet_length("text") <= MAX_QUERY_BYTES))
    queries = materialise(queries if "first_ms" in queries.columns else with_windows(queries, p.now_ms), "queries")
    nodes = store.nodes.withColumnRenamed("id", "node_id")
    tags = store.tags.groupBy("node_id").agg(F.collect_set("tag").alias("tags")) if store.tags is not None and p.tags else None
    keep = nodes.filter(F.col("fact_type").isin(*p.types))
    if tags is not None:
        keep = keep.join(tags, "node_id", "left").filter(tag_match(F.col("tags"), list(p.tags), p.tag_mode))
    keep = keep.select("node_id")

    def allowed(arm: DataFrame) -> DataFrame:
        return top(arm.join(keep, "node_id", "left_semi").withColumnRenamed("rank", "_r"), ["qid"], [F.col("_r")], None).drop("_r")

    arms = {"bm25": allowed(bm25(queries, store.nodes, p.fetch, p.types, store.index)), "temporal": allowed(temporal_arm(queries, store.nodes, p.fetch))}
    if store.vectors is not None:
        near = knn(queries, store.vectors, p.fetch)
        if p.embedding_model is not None:  # after the k nearest, as the index does not know the model
            near = near.join(store.vectors.filter(F.col("embedding_model") == p.embedding_model).select("node_id"), "node_id", "left_semi")
        arms["semantic"] = allowed(near)
    arms = {name: materialise(arm.select("qid", "node_id", "rank", "score"), name) for name, arm in arms.items()}
    if store.links is not None:
        first = fuse(arms, p.rrf_k, p.cap_per_source).filter(F.col("rrf_rank") <= p.seeds)
        seeds = first.join(queries.select("qid", "bank_id"), "qid").select("qid", "bank_id", "node_id")
        arms["graph"] = materialise(allowed(graph_arm(materialise(seeds, "seeds"), store, p.graph_cap)).select("qid", "node_id", "rank", "score"), "graph")
    merged = fuse(arms, p.rrf_k, p.cap_per_source)
    columns = ["node_id", "bank_id", "fact_type", "text", "context", "occurred_start", "occurred_end", "mentioned_at", "proof_count"]
    candidates = merged.join(nodes.select(*columns), "node_id").join(queries.select("qid", F.col("text").alias("query_text"), "first_ms", "last_ms"), "qid").withColumn("base", F.lit(None).cast("double"))
    if scorer is not None:
        candidates = rerank(candidates, scorer)
    ranked = materialise(score(candidates, p.now_ms, p.semantic_alpha).withColumn("tokens", T.count_words(F.col("text"))), "ranked")
    if store.sources is not None:
        ranked = drop_restatements(ranked, store.sources)
    ranked = top(drop_same_texts(ranked), ["qid"], [F.col("final_rank")], 2 * BUDGETS[p.budget], "_place")
    return top(within_tokens(ranked, p.max_tokens).drop("_place"), ["qid"], [F.col("final_rank")], p.limit, "place")
