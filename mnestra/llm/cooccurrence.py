"""Problem 2: items that appear together, and how far that exceeds chance.

Method: large-basket blocking.  A basket (record) of at most ``chunk`` items
yields its pairs at once.  A larger one is split into chunks of items by hash;
every pair of chunks is a row of its own, so that the products are spread over
tasks, and items too rare for any pair to reach ``min_together`` are dropped from
it first (a pair is never more frequent than its rarer item, so nothing is lost).
Both kinds of pairs are counted together, with partial sums before the shuffle.

Defined results: items are compared without outer blanks and in lower case; null
and empty items do not count; an item counts once per basket however often it is
listed and however often the basket is repeated; a basket without items still
counts for its group; groups that are null are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnestra.session import materialise


def clean_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _pairs_of_chunks(items: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """Pairs of the items of large baskets: ``items(*keys, item, n)``, n being the basket's size."""
    chunks = items.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
    packed = chunks.groupBy(*keys, "chunks", "chunk").agg(F.collect_list("item").alias("items"))
    met = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select(*keys, F.least("chunk", "with").alias("c1"), F.greatest("chunk", "with").alias("c2"), F.struct("chunk", "items").alias("side"))
    product = met.groupBy(*keys, "c1", "c2").agg(F.collect_list("side").alias("sides"))  # one or two chunks each
    across = "flatten(transform(sides[0].items, x -> transform(sides[1].items, y -> struct(least(x, y) AS item_1, greatest(x, y) AS item_2))))"
    within = _within("array_sort(sides[0].items)")
    return product.filter("size(sides) = 2 or c1 = c2").select(keys[0], F.expr(f"inline(if(c1 = c2, {within}, {across}))"))


def _within(items: str) -> str:
    return f"flatten(transform({items}, (x, i) -> transform(slice({items}, i + 2, size({items})), y -> struct(x AS item_1, y AS item_2))))"


def cooccurrence(baskets: DataFrame, group: str, keys: list[str], items: str, min_together: int = 1, chunk: int = 64) -> DataFrame:
    """Pairs of items that stand together in at least ``min_together`` baskets.

    Gives (group, item_1, item_2, together, baskets_1, baskets_2, baskets, lift,
    npmi), item_1 < item_2 by code point; ``keys`` name a basket within a group.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    base = baskets.select(F.col(group).alias("grp"), *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(items).alias("items")).filter("grp is not null")
    keyed = ["grp", *names]
    listed = base.select(*keyed, F.array_distinct(F.filter(F.transform("items", clean_name), lambda x: x.isNotNull() & (x != ""))).alias("items"))
    listings = listed.select(*keyed, F.greatest(F.size("items"), F.lit(0)).alias("n")).groupBy(*keyed).agg(F.sum("n").alias("n"))
    total = listings.groupBy("grp").agg(F.count(F.lit(1)).alias("baskets"))
    some = listed.filter(F.size("items") > 0)
    large_keys = materialise(listings.filter(F.col("n") > chunk).select(*[F.col(c).alias(f"l_{c}") for c in keyed]), "large-baskets")
    is_large = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in keyed]
    any_large = large_keys.limit(1).count() > 0
    ordinary = some.join(large_keys, is_large, "left_anti") if any_large else some
    # an ordinary basket lists at most `chunk` items over all its rows, so its list is bounded
    sets = ordinary.groupBy(*keyed).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    sets = materialise(sets.select("grp", "items"), "baskets")
    items = sets.select("grp", F.explode("items").alias("item"))
    pairs = sets.filter(F.size("items") > 1).select("grp", F.expr(f"inline({_within('items')})"))
    if any_large:
        rows = materialise(some.join(large_keys, is_large, "left_semi").select(*keyed, F.explode("items").alias("item")).distinct(), "large-items")
        items = items.unionByName(rows.select("grp", "item"))
    single = items.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_together)
    if any_large:
        sizes = rows.groupBy(*keyed).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(c).alias(f"l_{c}") for c in keyed], "n")
        large = rows.join(sizes, is_large).join(single.select("grp", "item"), ["grp", "item"], "left_semi").select(*keyed, "item", "n")
        pairs = pairs.unionByName(_pairs_of_chunks(large, keyed, chunk))
    together = pairs.groupBy("grp", "item_1", "item_2").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= min_together)
    one = single.select("grp", F.col("item").alias("item_1"), F.col("n").alias("baskets_1"))
    two = single.select("grp", F.col("item").alias("item_2"), F.col("n").alias("baskets_2"))
    scored = together.join(one, ["grp", "item_1"]).join(two, ["grp", "item_2"]).join(total, "grp")
    lift = F.col("together") * F.col("baskets") / (F.col("baskets_1").cast("double") * F.col("baskets_2"))
    share = -F.log(F.col("together") / F.col("baskets"))
    return scored.select(F.col("grp").alias(group), "item_1", "item_2", "together", "baskets_1", "baskets_2", "baskets", lift.alias("lift"), F.when(share > 0, F.log(lift) / share).otherwise(1.0).alias("npmi"))
