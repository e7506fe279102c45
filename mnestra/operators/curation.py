"""Consolidation of facts into observations, and mental models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnestra.functions import text as T
from mnestra.functions.timex import DAY_MS
from mnestra.operators.retrieval import knn, top
from mnestra.session import materialise

PLAN = (
    "struct<creates:array<struct<text:string,source_fact_ids:array<bigint>,reason:string>>,"
    "updates:array<struct<observation_id:bigint,text:string,source_fact_ids:array<bigint>,reason:string>>,"
    "deletes:array<struct<observation_id:bigint,reason:string>>>"
)


def watermarks(runs: DataFrame) -> DataFrame:
    """(bank_id, watermark): the largest of every bank's runs, 0 without any."""
    return runs.groupBy("bank_id").agg(F.coalesce(F.max("watermark"), F.lit(0)).alias("watermark"))


def pending(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Facts above the watermark of their bank, by id."""
    facts = nodes.filter(F.col("fact_type") != "observation")
    return facts.join(marks, "bank_id", "left").filter(F.col("id") > F.coalesce("watermark", F.lit(0))).drop("watermark")


def batches(facts: DataFrame, round_size: int = 50, batch_size: int = 8) -> DataFrame:
    """The next ``round_size`` facts of every bank in batches; adds ``place`` and ``batch``."""
    chosen = top(facts, ["bank_id"], [F.col("id")], round_size, "place")
    return chosen.withColumn("batch", F.floor((F.col("place") - 1) / batch_size))


def pool(candidates: DataFrame, max_tokens: int = 512) -> DataFrame:
    """(batch_id, observation_id, place): the union of the batch's recalled observations, first seen first.

    ``candidates(batch_id, fact_place, rank, observation_id, tokens)``.  Taken
    while their sizes add up to at most ``max_tokens``; the first is always taken.
    """
    seen = candidates.groupBy("batch_id", "observation_id", "tokens").agg(F.min(F.struct("fact_place", "rank")).alias("first"))
    placed = top(seen, ["batch_id"], [F.col("first"), F.col("observation_id")], None, "place")
    run = Window.partitionBy("batch_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("total", F.sum("tokens").over(run)).filter((F.col("total") <= max_tokens) | (F.col("place") == 1)).select("batch_id", "observation_id", "place")


def source_facts(sources: DataFrame, per_observation: int = 256, in_all: int = 1536) -> DataFrame:
    """The newest source facts of pooled observations within two token limits.

    ``sources(batch_id, place, observation_id, fact_id, tokens)``.  An observation
    stops at its first fact that does not fit either limit; what it took counts
    against the limit of the whole.  The state carries over from observation to
    observation, so the pool (a bounded list) is folded in order.
    """
    item = F.struct("place", (-F.col("fact_id")).alias("neg"), "observation_id", "fact_id", "tokens")
    lists = sources.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    taken = (
        "aggregate(items, named_struct('place', -1, 'own', 0L, 'all', 0L, 'stop', false, 'kept', cast(array() as array<struct<observation_id:bigint,fact_id:bigint>>)), (a, x) -> "
        f"if(x.place = a.place and a.stop, a, if((if(x.place = a.place, a.own, 0L)) + x.tokens <= {per_observation} and a.all + x.tokens <= {in_all}, "
        "named_struct('place', x.place, 'own', (if(x.place = a.place, a.own, 0L)) + x.tokens, 'all', a.all + x.tokens, 'stop', false, "
        "'kept', array_append(a.kept, named_struct('observation_id', x.observation_id, 'fact_id', x.fact_id))), "
        "named_struct('place', x.place, 'own', if(x.place = a.place, a.own, 0L), 'all', a.all, 'stop', true, 'kept', a.kept))), a -> a.kept)"
    )
    typed = lists.withColumn("items", F.expr("transform(items, x -> named_struct('place', cast(x.place as int), 'observation_id', x.observation_id, 'fact_id', x.fact_id, 'tokens', cast(x.tokens as bigint)))"))
    return typed.select("batch_id", F.expr(f"inline({taken})"))


def prefix_within(items: DataFrame, by: str, place: str, tokens: str, fixed: int, most: int, least_items: int = 0) -> DataFrame:
    """Items of a prompt in order, cut from the end until the whole (with ``fixed`` tokens) is within ``most``."""
    run = Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("total", F.sum(tokens).over(run) + fixed).filter((F.col("total") <= most) | (F.col(place) <= least_items))


def assemble_prompts(facts: DataFrame, pooled: DataFrame, fixed: int = 0, most: int = 6144) -> DataFrame:
    """(batch_id, fits, total, kept): what of a batch's pool goes into its prompt.

    ``facts(batch_id, tokens)`` all go in; ``pooled(batch_id, place, tokens)`` from
    the first on while the whole is within ``most``.  A batch whose facts alone are above does not fit.
    """
    base = facts.groupBy("batch_id").agg((F.sum("tokens") + fixed).alias("base"))
    run = Window.partitionBy("batch_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    taken = pooled.join(base, "batch_id").withColumn("total", F.col("base") + F.sum("tokens").over(run)).filter(F.col("total") <= most)
    sums = taken.groupBy("batch_id").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("kept"))
    return base.join(sums, "batch_id", "left").select("batch_id", (F.col("base") <= most).alias("fits"), F.coalesce("total", "base").alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))


def halve_batches(facts: DataFrame, over: DataFrame) -> DataFrame:
    """``facts(batch_id, place, ...)`` with the batches of ``over(batch_id)`` cut in two, in order; a batch of one fact is given up."""
    order = Window.partitionBy("batch_id")
    placed = facts.join(over.select("batch_id").distinct().withColumn("_over", F.lit(True)), "batch_id", "left").withColumns({"_n": F.count(F.lit(1)).over(order), "_at": F.row_number().over(order.orderBy("place"))})
    half = F.when(F.col("_at") <= F.floor(F.col("_n") / 2), ".0").otherwise(".1")
    name = F.when(F.col("_over"), F.concat(F.col("batch_id").cast("string"), half)).otherwise(F.col("batch_id").cast("string"))
    return placed.filter(F.col("_over").isNull() | (F.col("_n") > 1)).withColumn("batch_id", name).drop("_over", "_n", "_at")


def fitting_batches(facts: DataFrame, fixed: int, most: int, rounds: int = 10) -> DataFrame:
    """Batches cut in halves until the tokens of each are within ``most``; a lone fact above goes."""
    for _ in range(rounds):
        over = facts.groupBy("batch_id").agg(F.sum("tokens").alias("n")).filter(F.col("n") + fixed > most).select("batch_id")
        if not over.limit(1).count():
            return facts
        facts = materialise(halve_batches(facts, over), "halves")
    return facts


def validate_plans(replies: DataFrame, pooled: DataFrame, facts: DataFrame, max_deletes: int = 2) -> DataFrame:
    """Actions (batch_id, action, observation_id, text, source_fact_ids) of model replies that hold.

    A reply with two updates of one observation, with more than ``max_deletes`` deletes or that
    cannot be read is rejected whole.  Creates and updates need a text, a reason
    and facts of the batch: one that cites none, or any that is not known, goes whole;
    updates and deletes need an observation of the batch's pool;
    a delete of an observation that is also updated goes.  Texts are trimmed.
    """
    read = replies.select("batch_id", F.from_json("reply", PLAN).alias("p")).filter("p is not null and (p.creates is not null or p.updates is not null or p.deletes is not null)")
    ids = F.transform(F.coalesce("p.updates", F.array().cast("array<struct<observation_id:bigint,text:string,source_fact_ids:array<bigint>,reason:string>>")), lambda u: u["observation_id"])
    sound = read.filter((F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.coalesce("p.deletes", F.array().cast("array<struct<observation_id:bigint,reason:string>>"))) <= max_deletes))
    none = F.lit(None)
    creates = sound.select("batch_id", F.posexplode("p.creates").alias("nth", "c")).select("batch_id", "nth", F.lit("create").alias("action"), none.cast("bigint").alias("observation_id"), F.col("c.text").alias("text"), F.col("c.source_fact_ids").alias("ids"), F.col("c.reason").alias("reason"))
    updates = sound.select("batch_id", F.posexplode("p.updates").alias("nth", "c")).select("batch_id", "nth", F.lit("update").alias("action"), "c.observation_id", "c.text", F.col("c.source_fact_ids").alias("ids"), "c.reason")
    deletes = sound.select("batch_id", F.posexplode("p.deletes").alias("nth", "c")).select("batch_id", "nth", F.lit("delete").alias("action"), "c.observation_id", none.cast("string").alias("text"), F.array().cast("array<bigint>").alias("ids"), "c.reason")
    said = F.trim(F.coalesce("reason", F.lit(""))) != ""
    texts = creates.unionByName(updates).filter(said & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    known = facts.select("batch_id", F.col("fact_id").alias("id")).distinct()
    cited = texts.select("batch_id", "action", "nth", F.explode(F.array_distinct("ids")).alias("id")).join(known.withColumn("known", F.lit(True)), ["batch_id", "id"], "left")
    backed = cited.groupBy("batch_id", "action", "nth").agg(F.array_sort(F.collect_list("id")).alias("source_fact_ids"), F.count_if(F.col("known").isNull()).alias("unknown")).filter("unknown = 0").drop("unknown")
    texts = texts.join(backed, ["batch_id", "action", "nth"]).withColumn("text", F.trim("text"))
    there = pooled.select("batch_id", "observation_id").distinct()
    held = texts.filter("action = 'create'").select("batch_id", "action", "nth", "observation_id", "text", "source_fact_ids")
    changed = texts.filter("action = 'update'").join(there, ["batch_id", "observation_id"], "left_semi").select("batch_id", "action", "nth", "observation_id", "text", "source_fact_ids")
    gone = deletes.filter(said).join(there, ["batch_id", "observation_id"], "left_semi").join(changed.select("batch_id", "observation_id"), ["batch_id", "observation_id"], "left_anti")
    return held.unionByName(changed).unionByName(gone.select("batch_id", "action", "nth", "observation_id", "text", F.col("ids").alias("source_fact_ids")))


def apply_updates(observations: DataFrame, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """A new snapshot: deleted rows gone, texts replaced; a changed text loses its embedding and keeps its sources."""
    new = updates.select(F.col("observation_id").alias("id"), F.col("text").alias("new_text"))
    rows = observations.join(deletes.select(F.col("observation_id").alias("id")), "id", "left_anti").join(new, "id", "left")
    changed = F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text"))
    return rows.withColumns({"embedding": F.when(~changed, F.col("embedding")), "text": F.coalesce("new_text", "text")}).drop("new_text")


def apply_plans(observations: DataFrame, sources: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and provenance after the actions of plans.

    ``observations(id, bank_id, text, embedding)``, ``sources(observation_id, source_id)``,
    ``actions(batch_id, action, observation_id, text, source_fact_ids)``, batches being named by their bank.
    Creates get the next ids, by bank and text; updates add their sources; deletes take theirs along.
    Gives the observations with ``proof_count`` and the provenance.
    """
    actions = materialise(actions.select("batch_id", "action", "observation_id", "text", "source_fact_ids"), "actions")
    most = observations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    made = actions.filter("action = 'create'").select(F.col("batch_id").alias("bank_id"), "text", F.col("source_fact_ids").alias("facts")).withColumn("_key", F.xxhash64("bank_id", "text", "facts"))
    order = Window.partitionBy("bank_id").orderBy("text", "_key")  # a plan creates a handful
    sizes = made.groupBy("bank_id").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("bank_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bank_id", before.alias("_before"))  # one row a bank
    made = made.withColumn("_nth", F.row_number().over(order)).join(starts, "bank_id").join(F.broadcast(most)).withColumn("id", F.col("most") + F.col("_before") + F.col("_nth"))
    changes, gone = actions.filter("action = 'update'"), actions.filter("action = 'delete'")
    kept = apply_updates(observations, changes, gone)
    rows = kept.select("id", "bank_id", "text", "embedding").unionByName(made.select("id", "bank_id", "text", F.lit(None).cast(dict(observations.dtypes)["embedding"]).alias("embedding")))
    added = changes.join(observations.select(F.col("id").alias("observation_id")), "observation_id", "left_semi").select("observation_id", F.explode("source_fact_ids").alias("source_id"))
    backed = sources.join(gone.select("observation_id"), "observation_id", "left_anti").select("observation_id", "source_id").unionByName(added).unionByName(made.select(F.col("id").alias("observation_id"), F.explode("facts").alias("source_id"))).distinct()
    return rows.join(proof_counts(rows, backed), "id"), backed


def proof_counts(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, proof_count): how many distinct facts every observation rests on."""
    counts = sources.select("observation_id", "source_id").distinct().groupBy(F.col("observation_id").alias("id")).agg(F.count(F.lit(1)).alias("proof_count"))
    return observations.select("id").join(counts, "id", "left").fillna(0, ["proof_count"])


def near_twins(vectors: DataFrame, observations: DataFrame, threshold: float = 0.97, most: int = 5) -> DataFrame:
    """(observation_id, twin_id, similarity, nth): the most similar observations of the same bank and model."""
    held = vectors.join(observations.select(F.col("id").alias("node_id")), "node_id", "left_semi").filter("embedding is not null")
    held = held.withColumn("bank_id", F.concat_ws("\u0001", "bank_id", F.coalesce("embedding_model", F.lit(""))))  # other models are other spaces
    asked = held.select(F.col("node_id").alias("qid"), "bank_id", F.col("embedding").alias("vector")).dropDuplicates(["qid"])
    near = knn(asked, held, most + 1, threshold=threshold).filter("qid <> node_id")
    return top(near.select(F.col("qid").alias("observation_id"), F.col("node_id").alias("twin_id"), F.col("score").alias("similarity")), ["observation_id"], [F.desc("similarity"), F.col("twin_id")], most, "nth")


def first_fitting(twins: DataFrame, texts: DataFrame, max_tokens: int = 2048, overhead: int = 0) -> DataFrame:
    """The first twin whose prompt, with both texts, fits."""
    size = texts.select(F.col("id"), T.count_words(F.col("text")).alias("n"))
    both = twins.join(size.toDF("observation_id", "own"), "observation_id").join(size.toDF("twin_id", "theirs"), "twin_id").filter(F.col("own") + F.col("theirs") + overhead <= max_tokens)
    return top(both, ["observation_id"], [F.col("nth")], 1, "_n").select("observation_id", "twin_id", "similarity")


def adjudicated(twins: DataFrame, most: int = 8) -> DataFrame:
    """The twins that a round may put before a model: ``most`` a bank."""
    return top(twins, ["bank_id"], [F.col("observation_id")], most, "nth_case")


def decision(action: Column, text: Column, existing: Column) -> Column:
    """The text after a decision; null keeps both observations.  An empty merge text means the existing one."""
    return F.when(F.lower(F.trim(action)) == "merge", F.coalesce(F.nullif(F.trim(text), F.lit("")), existing))


def merge_twins(sources: DataFrame, merges: DataFrame) -> DataFrame:
    """Provenance after merges ``(kept_id, lost_id)``: the union of both sides' sources under the kept one."""
    moved = sources.join(merges.select(F.col("lost_id").alias("observation_id"), "kept_id"), "observation_id", "left")
    return moved.select(F.coalesce("kept_id", "observation_id").alias("observation_id"), "source_id").distinct()


def finish_runs(started: DataFrame, finished: DataFrame) -> DataFrame:
    """The ledger of runs: every started run with its figures, status ``running`` for one that has not finished."""
    figures = [c for c in finished.columns if c != "run_id"]
    return started.join(finished, "run_id", "left").withColumn("status", F.when(F.col(figures[0]).isNull(), "running").when(F.col("error").isNotNull(), "failed").otherwise("done"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run of every bank with the highest id."""
    return top(runs, ["bank_id"], [F.desc("run_id")], 1, "_n").drop("_n")


def observation_line(text: Column, start: Column, end: Column, proof: Column) -> Column:
    """An observation for a prompt, as JSON without null fields."""
    return F.to_json(F.struct(text.alias("text"), start.alias("occurred_start"), end.alias("occurred_end"), proof.alias("proof_count")))


def twin_prompt(one: Column, two: Column) -> Column:
    """Both texts as JSON strings, so that neither can pose as part of the prompt."""
    return F.to_json(F.struct(one.alias("first"), two.alias("second")))


# --- mental models --------------------------------------------------------------------------------


def latest_models(refreshes: DataFrame) -> DataFrame:
    """The current state of every model: the latest written refresh; its content is the latest that is not null."""
    order = Window.partitionBy("model_id").orderBy("written_at", "refresh_id").rowsBetween(Window.unboundedPreceding, 0)
    filled = refreshes.withColumn("current", F.last("content", ignorenulls=True).over(order))
    last = top(filled, ["model_id"], [F.desc("written_at"), F.desc("refresh_id")], 1, "_n")
    return last.select("model_id", "bank_id", F.col("current").alias("content"), "last_refreshed_at", "refresh_watermark", "written_at")


def list_models(models: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of every bank's models: the latest refreshed first, those never refreshed last."""
    placed = top(models, ["bank_id"], [F.desc_nulls_last("last_refreshed_at"), F.desc("written_at"), F.col("model_id")], offset + limit, "place")
    return placed.filter(F.col("place") > offset)


def refresh_inputs(models: DataFrame, facts: DataFrame) -> DataFrame:
    """(model_id, facts, new_watermark): what was written in the bank after the model's watermark.

    Facts are counted by day and summed from the last day back; only those of the mark's own day are met one by one.
    """
    day = lambda c: F.floor(F.col(c) / DAY_MS)
    mark = models.select("model_id", "bank_id", F.coalesce("refresh_watermark", F.lit(-1)).alias("mark")).withColumn("day", day("mark"))
    by_time = facts.select("bank_id", "created_at").filter("created_at is not null").withColumn("day", day("created_at"))
    days = by_time.groupBy("bank_id", "day").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
    later = Window.partitionBy("bank_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    steps = days.withColumns({"n": F.sum("n").over(later), "last": F.max("last").over(later)})  # from a day on; one row a day
    # whole days after the mark: the least day with facts above the mark's day
    ahead = mark.join(days.select("bank_id", F.col("day").alias("d")), "bank_id").filter("d > day").groupBy("model_id", "bank_id").agg(F.min("d").alias("day")).join(steps, ["bank_id", "day"]).select("model_id", "n", "last")
    same = mark.join(by_time, ["bank_id", "day"]).filter("created_at > mark").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
    counted = ahead.unionByName(same).groupBy("model_id").agg(F.sum("n").alias("facts"), F.max("last").alias("new_watermark"))
    return mark.join(counted, "model_id", "left").select("model_id", "bank_id", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("new_watermark", F.nullif(F.col("mark"), F.lit(-1))).alias("new_watermark"))


def supporting_facts(recalled: DataFrame, nodes: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The recalled facts that were written after a model's watermark, in the order of the recall, and the new watermarks.

    ``recalled(model_id, place, node_id)``; a model that was never refreshed takes all.
    """
    marks = models.select("model_id", F.coalesce("refresh_watermark", F.lit(-1)).alias("mark"))
    facts = created_after(recalled.join(marks, "model_id"), nodes)
    return facts, facts.groupBy("model_id").agg(F.max("created_at").alias("new_watermark"))


def created_after(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``ids(node_id, mark, ...)`` whose node was written after the mark, with ``created_at``."""
    return ids.join(nodes.select(F.col("id").alias("node_id"), "created_at"), "node_id").filter("created_at > mark")


def assemble_refresh(facts: DataFrame, models: DataFrame, fixed: int = 0, most: int = 4096) -> DataFrame:
    """(model_id, with_content, kept, total): what goes into the prompt of a refresh.

    ``facts(model_id, place, tokens)``, ``models(model_id, tokens)``, tokens being those of the
    current content.  If all does not fit, the content goes first, then facts from the last on; a model of which
    no fact fits gets no prompt.
    """
    run = Window.partitionBy("model_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = facts.withColumn("upto", F.sum("tokens").over(run) + fixed).join(models.select("model_id", F.col("tokens").alias("content")), "model_id")
    whole = F.max("upto") + F.first("content")
    found = sums.groupBy("model_id").agg(
        (whole <= most).alias("with_content"),
        F.when(whole <= most, F.count(F.lit(1))).otherwise(F.count_if(F.col("upto") <= most)).alias("kept"),
        F.when(whole <= most, whole).otherwise(F.max(F.when(F.col("upto") <= most, F.col("upto")))).alias("total"),
    )
    return found.filter("kept > 0")


def assemble_reflection(memories: DataFrame, models: DataFrame, fixed: int = 0, most: int = 4096) -> DataFrame:
    """(qid, memories, models, total): memories go from the last on, then models; nothing if not even one item fits.

    ``memories(qid, place, tokens)``, ``models(qid, place, tokens)``.
    """
    both = models.select("qid", F.lit(0).alias("turn"), "place", "tokens").unionByName(memories.select("qid", F.lit(1).alias("turn"), "place", "tokens"))
    run = Window.partitionBy("qid").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, 0)
    fits = both.withColumn("upto", F.sum("tokens").over(run) + fixed).filter(F.col("upto") <= most)
    return fits.groupBy("qid").agg(F.sum("turn").alias("memories"), F.count_if(F.col("turn") == 0).alias("models"), F.max("upto").alias("total"))


def nearest_models(queries: DataFrame, vectors: DataFrame, k: int = 3, embedding_model: str | None = None) -> DataFrame:
    """(qid, model_no, score, rank): the nearest models of the query's bank; foreign producers go after the ``k`` nearest.

    ``vectors(model_no, bank_id, embedding, embedding_model)``.
    """
    near = knn(queries, vectors.withColumnRenamed("model_no", "node_id"), k).withColumnRenamed("node_id", "model_no")
    return near if embedding_model is None else near.join(vectors.filter(F.col("embedding_model") == embedding_model).select("model_no"), "model_no", "left_semi")


def apply_model_changes(models: DataFrame, changes: DataFrame) -> DataFrame:
    """Models ``(model_id, bank_id, name, content, embedding)`` after ``changes(model_id, action, ...)``, at most one a model.

    ``create`` adds a model that is not there, ``delete`` drops one, ``update`` sets what is not null;
    a changed name or content without a new vector clears the vector.
    """
    fields = ["bank_id", "name", "content", "embedding"]
    new = changes.select("model_id", "action", *[F.col(c).alias(f"_{c}") for c in fields])
    both = models.join(new, "model_id", "full_outer").withColumn("_there", F.col("bank_id").isNotNull())
    updated = (F.col("action") == "update") & F.col("_there")
    altered = updated & (~F.coalesce("_name", "name").eqNullSafe(F.col("name")) | ~F.coalesce("_content", "content").eqNullSafe(F.col("content")))
    made = (F.col("action") == "create") & ~F.col("_there")
    pick = lambda c: F.when(made, F.col(f"_{c}")).when(updated, F.coalesce(f"_{c}", c)).otherwise(F.col(c))
    vector = F.when(made | (altered & F.col("_embedding").isNotNull()), F.col("_embedding")).when(altered, F.lit(None)).otherwise(F.when(updated, F.coalesce("_embedding", "embedding")).otherwise(F.col("embedding")))
    kept = both.filter((F.col("_there") & ~F.coalesce(F.col("action") == "delete", F.lit(False))) | made)
    return kept.select("model_id", pick("bank_id").alias("bank_id"), pick("name").alias("name"), pick("content").alias("content"), vector.alias("embedding"))


def refresh_outcome(facts: Column, reply: Column, failed: Column) -> Column:
    """struct(outcome, replaces): without facts only the time is stamped, an empty reply is an error, else the content is replaced."""
    outcome = F.when(facts == 0, "no_facts").when(failed, "error").when(F.trim(F.coalesce(reply, F.lit(""))) == "", "empty_candidate").otherwise("updated")
    return F.struct(outcome.alias("outcome"), (outcome == "updated").alias("replaces"))


def keep_citations(cited: Column, available: Column) -> Column:
    """Cited ids that were there, each once, in the order cited."""
    return F.filter(F.array_distinct(cited), lambda i: F.array_contains(available, i))
