"""Building and reading the graph of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnestra.functions.timex import DAY_MS
from mnestra.operators.components import connected_components
from mnestra.operators.retrieval import knn, top
from mnestra.session import materialise

STRICT_MS = 60_480_000  # 16.8 hours: below, the weight of a temporal link falls strictly with the distance


def temporal_weight(distance_ms: Column) -> Column:
    return F.greatest(F.lit(0.3), 1 - distance_ms / float(DAY_MS))


def temporal_links(nodes: DataFrame, most: int = 20, block_days: int = 4) -> DataFrame:
    """Links to the nearest facts of the same bank and type within 24 hours: at most ``most`` a node.

    ``nodes(id, bank_id, fact_type, event_date)`` -> (from_node_id, to_node_id,
    weight).  The heaviest come first, then the least ids; beyond 16.8 hours all weights are
    0.3, so that ids alone decide there.

    Of the nodes at one time only the ``most`` + 1 least ids can be partners.  The
    ``most`` distinct times on either side (a window over (type, block of days), each
    block with a day of its neighbours) hold all partners nearer than 16.8 hours; only nodes with too few of
    these meet their whole band, by day buckets.  No more than ``most`` such nodes lie within 16.8 hours of each other.
    """
    base = nodes.filter("event_date is not null").select("id", "bank_id", "fact_type", F.col("event_date").alias("at")).distinct()
    key = ["bank_id", "fact_type"]
    first = top(base, [*key, "at"], [F.col("id")], most + 1, "_n")
    times = first.groupBy(*key, "at").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    width = block_days * DAY_MS
    block = lambda c: F.floor(c / F.lit(width))
    spread_out = times.withColumn("block", F.explode(F.sequence(block(F.col("at") - DAY_MS), block(F.col("at") + DAY_MS))))
    order = Window.partitionBy(*key, "block").orderBy("at")
    near = F.concat(*[F.collect_list(F.struct("at", "ids")).over(order.rowsBetween(*ends)) for ends in ((-most, -1), (1, most))], F.array(F.struct("at", "ids")))
    framed = spread_out.withColumn("near", near).filter(F.col("block") == block(F.col("at"))).select(*key, "at", "near")
    gaps = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(F.abs(x["at"] - F.col("at")).alias("gap"), i.alias("id")))))
    strict = F.slice(F.array_sort(F.filter(gaps, lambda g: g["gap"] < STRICT_MS)), 1, most + 1)
    framed = framed.select(*key, "at", strict.alias("strict"))
    met = base.join(framed, [*key, "at"]).withColumn("strict", F.slice(F.filter("strict", lambda g: g["id"] != F.col("id")), 1, most))
    easy = met.filter(F.size("strict") >= most).select(F.col("id").alias("from_node_id"), F.explode("strict").alias("g")).select("from_node_id", F.col("g.id").alias("to_node_id"), F.col("g.gap").alias("gap"))
    hard = met.filter(F.size("strict") < most).select("id", *key, "at").withColumn("day", F.explode(F.array(*[F.floor(F.col("at") / DAY_MS) + d for d in (-1, 0, 1)])))
    other = base.select(F.col("id").alias("to_node_id"), *key, F.col("at").alias("to_at")).withColumn("day", F.floor(F.col("to_at") / DAY_MS))
    band = hard.join(other, [*key, "day"]).withColumn("gap", F.abs(F.col("at") - F.col("to_at"))).filter((F.col("gap") <= DAY_MS) & (F.col("id") != F.col("to_node_id")))
    pairs = easy.unionByName(band.select(F.col("id").alias("from_node_id"), "to_node_id", "gap")).withColumn("weight", temporal_weight(F.col("gap")))
    return top(pairs, ["from_node_id"], [F.desc("weight"), F.col("to_node_id")], most, "nth").select("from_node_id", "to_node_id", F.round("weight", 6).alias("weight"))


def semantic_links(vectors: DataFrame, nodes: DataFrame, threshold: float = 0.7, k: int = 100, most: int = 20) -> DataFrame:
    """Links to similar facts: of the ``k`` nearest of any type, those of the same type at or above ``threshold``."""
    typed = vectors.join(nodes.select(F.col("id").alias("node_id"), "fact_type"), "node_id")
    asked = typed.select(F.col("node_id").alias("qid"), "bank_id", F.col("embedding").alias("vector"), "fact_type").dropDuplicates(["qid"])
    near = knn(asked, vectors, k).filter(F.col("score") >= threshold)
    types = nodes.select(F.col("id").alias("node_id"), F.col("fact_type").alias("to_type"))
    own = nodes.select(F.col("id").alias("qid"), "fact_type")
    linked = near.join(own, "qid").join(types, "node_id").filter("qid <> node_id and fact_type = to_type")
    return top(linked, ["qid"], [F.desc("score"), F.col("node_id")], most, "nth").select(F.col("qid").alias("from_node_id"), F.col("node_id").alias("to_node_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("weight"))


def causal_links(facts: DataFrame, placed: DataFrame) -> DataFrame:
    """Links of weight 1 from facts to the facts they name as causes, by position in their document.

    ``facts(document_id, fact_index, causal_relations)``, ``placed(document_id,
    fact_index, id)``.  Targets that do not exist, and a fact itself, give no link.
    """
    named = facts.select("document_id", "fact_index", F.explode("causal_relations").alias("r")).select("document_id", "fact_index", F.col("r.target_fact_index").alias("target")).filter("target <> fact_index").distinct()
    source = placed.select("document_id", "fact_index", F.col("id").alias("from_node_id"))
    goal = placed.select("document_id", F.col("fact_index").alias("target"), F.col("id").alias("to_node_id"))
    return named.join(source, ["document_id", "fact_index"]).join(goal, ["document_id", "target"]).filter("from_node_id <> to_node_id").select("from_node_id", "to_node_id", F.lit("caused_by").alias("link_type"), F.lit(1.0).alias("weight")).distinct()


def insert_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored links and the new ones: weights clamped to [0, 1], the first row of a key stays."""
    key = ["from_node_id", "to_node_id", "link_type", "entity_id"]
    clamp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight")))
    rows = stored.select(*key, clamp.alias("weight"), "created_at", F.lit(0).alias("turn")).union(new.select(*key, clamp.alias("weight"), "created_at", F.lit(1).alias("turn")))
    first = rows.groupBy(*key).agg(F.min(F.struct("turn", "created_at", "weight")).alias("first"))
    return first.select(*key, "first.weight", "first.created_at")


def mention_rollup(mentions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(bank_id, name, mention_count, first_seen, last_seen) of ``mentions(bank_id, name, at)``, added to stored rows."""
    rows = mentions.select("bank_id", "name", F.lit(1).cast("long").alias("n"), F.col("at").alias("first"), F.col("at").alias("last"))
    if stored is not None:
        rows = rows.unionByName(stored.select("bank_id", "name", F.col("mention_count").alias("n"), F.col("first_seen").alias("first"), F.col("last_seen").alias("last")))
    return rows.groupBy("bank_id", "name").agg(F.sum("n").alias("mention_count"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def entity_cooccurrence(members: DataFrame, chunk: int = 64) -> DataFrame:
    """(entity_id_1, entity_id_2, together, last_at) of ``members(node_id, entity_id, at)``.

    The entities of a node are cut into chunks of at most about ``chunk``, and each pair of
    chunks is a row of its own, so a node with very many entities is worked on by many tasks.
    """
    unique = members.groupBy("node_id", "entity_id").agg(F.max("at").alias("at"))
    sizes = unique.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"), F.max("at").alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = unique.select("node_id", "entity_id").join(sizes, "node_id").withColumn("own", F.pmod(F.xxhash64("entity_id"), F.col("chunks")).cast("int"))
    lists = cut.groupBy("node_id", "at", "chunks", "own").agg(F.array_sort(F.collect_list("entity_id")).alias("e"))
    within = F.expr("inline(flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> struct(x AS entity_id_1, y AS entity_id_2)))))")
    pairs = lists.select("at", within)
    wide = lists.filter("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("own <> other")
    met = wide.groupBy("node_id", "at", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2")).agg(F.collect_list("e").alias("sides")).filter("size(sides) = 2")
    across = F.expr("inline(flatten(transform(sides[0], x -> transform(sides[1], y -> struct(least(x, y) AS entity_id_1, greatest(x, y) AS entity_id_2)))))")
    return pairs.unionByName(met.select("at", across)).groupBy("entity_id_1", "entity_id_2").agg(F.count(F.lit(1)).alias("together"), F.max("at").alias("last_at"))


def resolution_context(entities: DataFrame, pairs: DataFrame, newest: int = 5000, partners: int = 64) -> DataFrame:
    """(bank_id, id, canonical_name, partner_ids): the newest entities of every bank and their most frequent partners."""
    recent = top(entities, ["bank_id"], [F.desc_nulls_last("last_seen"), F.col("id")], newest, "nth")
    both = pairs.select(F.col("entity_id_1").alias("id"), F.col("entity_id_2").alias("partner"), "together").union(pairs.select("entity_id_2", "entity_id_1", "together"))
    best = top(both, ["id"], [F.desc("together"), F.col("partner")], partners, "nth").groupBy("id").agg(F.array_sort(F.collect_list("partner")).alias("partner_ids"))
    return recent.join(best, "id", "left").select("bank_id", "id", "canonical_name", F.coalesce("partner_ids", F.array().cast("array<bigint>")).alias("partner_ids"))


def view_nodes(nodes: DataFrame, types: list[str] | None = None, since: int | None = None, until: int | None = None, limit: int | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """Nodes of every bank for a view: filters on type, event date and tag; the newest ids first."""
    if types:
        nodes = nodes.filter(F.col("fact_type").isin(*types))
    if since is not None:
        nodes = nodes.filter(F.col("event_date") >= since)
    if until is not None:
        nodes = nodes.filter(F.col("event_date") <= until)
    if tagged is not None:
        nodes = nodes.join(tagged.select(F.col("node_id").alias("id")), "id", "left_semi")
    return nodes if limit is None else top(nodes, ["bank_id"], [F.desc("id")], limit, "nth").drop("nth")


def names_of_nodes(nodes: DataFrame, entities: DataFrame, node_entities: DataFrame) -> DataFrame:
    """(node_id, names): the entities of every node of a view, by name.  ``entities(id, name)``, ``node_entities(node_id, entity_id)``."""
    wanted = node_entities.select("node_id", "entity_id").distinct().join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return wanted.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("node_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def node_detail(nodes: DataFrame, tags: DataFrame, entities: DataFrame, node_entities: DataFrame, sources: DataFrame, links: DataFrame, most: int = 50, per_type: int = 20) -> DataFrame:
    """(node_id, tags, names, source_ids, cited_by, neighbours) of every node, as arrays or null.

    At most ``most`` sources and citing observations, the least ids; ``neighbours`` are (link_type, other_id, weight), the heaviest ``per_type`` of each type.
    """
    listed = lambda df, by, value, name: df.groupBy(F.col(by).alias("node_id")).agg(F.array_sort(F.collect_list(value)).alias(name))
    near = neighbours(links, per_type).groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("link_type", "nth", "other_id", "weight"))), lambda x: F.struct(x["link_type"].alias("link_type"), x["other_id"].alias("other_id"), x["weight"].alias("weight"))).alias("neighbours"))
    out = nodes.select(F.col("id").alias("node_id"))
    parts = (
        listed(tags, "node_id", "tag", "tags"),
        names_of_nodes(nodes, entities, node_entities),
        listed(top(sources, ["observation_id"], [F.col("source_id")], most, "nth"), "observation_id", "source_id", "source_ids"),
        listed(top(sources, ["source_id"], [F.col("observation_id")], most, "nth"), "source_id", "observation_id", "cited_by"),
        near,
    )
    for part in parts:
        out = out.join(part, "node_id", "left")
    return out


def induced_edges(nodes: DataFrame, links: DataFrame, per_node: int = 50) -> DataFrame:
    """Links with both ends among the nodes of a bank; at most ``per_node`` times the number of its nodes."""
    ends = nodes.select("id", "bank_id")
    inside = links.join(ends.withColumnsRenamed({"id": "from_node_id"}), "from_node_id").join(ends.select(F.col("id").alias("to_node_id"), F.col("bank_id").alias("to_bank")), "to_node_id").filter("bank_id = to_bank")
    unique = inside.select("bank_id", "from_node_id", "to_node_id", "link_type", "entity_id", "weight").groupBy("bank_id", "from_node_id", "to_node_id", "link_type", "entity_id").agg(F.max("weight").alias("weight"))
    unique = materialise(unique, "view-edges")
    size = ends.groupBy("bank_id").agg((F.count(F.lit(1)) * per_node).alias("most"))
    over = unique.groupBy("bank_id").agg(F.count(F.lit(1)).alias("n")).join(size, "bank_id").filter("n > most").select("bank_id", "most")  # only these banks are ranked
    columns = unique.columns
    ranked = top(unique.join(over, "bank_id"), ["bank_id"], [F.desc("weight"), F.col("from_node_id"), F.col("to_node_id"), F.col("link_type"), F.col("entity_id")], None, "nth").filter("nth <= most")
    return unique.join(over.select("bank_id"), "bank_id", "left_anti").select(*columns).unionByName(ranked.select(*columns))


def neighbours(links: DataFrame, per_type: int = 20) -> DataFrame:
    """(node_id, link_type, other_id, weight, nth): the heaviest neighbours of every node by type, both directions."""
    both = links.select(F.col("from_node_id").alias("node_id"), F.col("to_node_id").alias("other_id"), "link_type", "weight").union(links.select("to_node_id", "from_node_id", "link_type", "weight")).filter("node_id <> other_id")
    best = both.groupBy("node_id", "link_type", "other_id").agg(F.max("weight").alias("weight"))
    return top(best, ["node_id", "link_type"], [F.desc("weight"), F.col("other_id")], per_type, "nth")


def quantile_at(ordered: Column, n: Column, q: float) -> Column:
    """The element at floor(n q) of a sorted array, the last at most."""
    return F.element_at(ordered, F.least(F.floor(n * F.lit(q)), n - 1).cast("int") + 1)


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(bank_id, node_id, degree): distinct links at every node, 0 without any."""
    unique = links.select("from_node_id", "to_node_id", "link_type", "entity_id").distinct()
    ends = unique.select(F.col("from_node_id").alias("node_id")).union(unique.select("to_node_id"))
    return nodes.select("bank_id", F.col("id").alias("node_id")).join(ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")), "node_id", "left").fillna(0, ["degree"])


def quantiles_by_rank(values: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles at index min(floor(n q), n - 1) from counts of distinct values, so no group is sorted in one task."""
    counts = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*by))})
    out = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * F.lit(q)), F.col("all") - 1), F.col(value))).alias(name) for name, q in quantiles.items()]
    return placed.groupBy(*by).agg(F.first("all").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("n")) / F.first("all")).alias("mean"), *out)


LINK_TYPES = ("semantic", "temporal", "entity", "caused_by", "causes", "enables", "prevents")


def anatomy(nodes: DataFrame, links: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row a bank: nodes, links (also by type), cross-type links, provenance edges, isolated nodes, degrees and components.

    ``sources(observation_id, source_id)`` are the provenance edges; they join no components.
    """
    place = nodes.select(F.col("id"), "bank_id", "fact_type")
    unique = links.select("from_node_id", "to_node_id", "link_type", "entity_id").distinct()
    inside = unique.join(place.toDF("from_node_id", "bank_id", "from_type"), "from_node_id").join(place.toDF("to_node_id", "to_bank", "to_type"), "to_node_id").filter("bank_id = to_bank")
    inside = materialise(inside.select("bank_id", "from_node_id", "to_node_id", "link_type", "entity_id", "from_type", "to_type"), "inside")
    typed = [F.count_if(F.col("link_type") == t).alias(f"{t}_links") for t in LINK_TYPES]
    linked = inside.groupBy("bank_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("from_type") != F.col("to_type")).alias("cross_type_links"), *typed)
    degree = degrees(nodes, inside)
    spread = quantiles_by_rank(degree, ["bank_id"], "degree", {"degree_p50": 0.5, "degree_p90": 0.9}).select("bank_id", F.col("n").alias("nodes"), F.col("min").alias("degree_min"), "degree_p50", "degree_p90", F.col("max").alias("degree_max"), F.round("mean", 6).alias("degree_mean"))
    alone = degree.groupBy("bank_id").agg(F.count_if(F.col("degree") == 0).alias("isolated"))
    parts = components(nodes, inside)
    counted = parts.groupBy("bank_id", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bank_id").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest_component"))
    out = spread.join(linked, "bank_id", "left").join(alone, "bank_id").join(counted, "bank_id")
    if sources is not None:
        backed = sources.distinct().join(place.select(F.col("id").alias("observation_id"), "bank_id"), "observation_id").groupBy("bank_id").agg(F.count(F.lit(1)).alias("provenance_edges"))
        out = out.join(backed, "bank_id", "left")
    return out.fillna(0)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(bank_id, node_id, component): every node, alone if it has no link.  ``links`` lie within banks, named by ``bank_id``."""
    found = connected_components(links.select(F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"), "bank_id"), group="bank_id").withColumnRenamed("node", "node_id")
    return nodes.select("bank_id", F.col("id").alias("node_id")).join(found, "node_id", "left").select("bank_id", "node_id", F.coalesce("component", "node_id").alias("component"))


def largest_components(nodes: DataFrame, links: DataFrame, most: int = 12) -> DataFrame:
    """(bank_id, component, n, world, experience, observation) of the largest components of every bank."""
    parts = components(nodes, links).join(nodes.select(F.col("id").alias("node_id"), "fact_type"), "node_id")
    mix = [F.count_if(F.col("fact_type") == t).alias(t) for t in ("world", "experience", "observation")]
    return top(parts.groupBy("bank_id", "component").agg(F.count(F.lit(1)).alias("n"), *mix), ["bank_id"], [F.desc("n"), F.col("component")], most, "nth")
