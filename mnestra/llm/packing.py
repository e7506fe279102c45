"""Problem 6: filling containers of fixed capacity with texts.

Method: grouping genetic algorithm.  A solution is a list of containers.  Crossover
takes well-filled containers from one parent whole, drops the containers of the
other that hold an item twice, and fits the displaced items anew.  Mutation empties
badly filled containers and some others.  Displaced items come back in one of two ways:
they take the place of smaller ones where a container gets fuller by it, and what is
then displaced goes where the least room is left, the largest first; or new containers
are begun with the largest, each completed by the items whose sizes add up closest to
its room.  Items are dealt by hash into blocks
of about ``block_items``; on every block several islands evolve and pass their
best solution on to the next island between the rounds.  An island ends early
where it meets the lower bound.  Containers that stay
badly filled are emptied and packed again together with those of other blocks, until one
block is left.

Only a text larger than the capacity is split: into full containers and a rest,
which is packed like any other text.

Defined results: a text without tokens gets a place and takes no room; a null
text gets a row without a container; rows repeated in the input are texts of
their own, numbered as copies; the result follows from ids and sizes alone, not from the
order of rows or files; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.llm.tokens import VOCABULARY, with_copies, with_token_counts
from mnestra.session import materialise


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Put items, in the order given, where the least room is left, opening containers as needed."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for item in items:
        at = bisect.bisect_left(room, (sizes[item], -1))
        if at == len(room):
            bins.append([item])
            bisect.insort(room, (capacity - sizes[item], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(item)
            bisect.insort(room, (left - sizes[item], k))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by the sum, and by the items that cannot share a container."""
    s = np.sort(np.asarray(sizes, np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    below = lambda x: int(np.searchsorted(s, x, side="right"))
    best, half = -(-int(total[-1]) // capacity), below(capacity // 2)
    for least in np.unique(s[:half]):
        alone, first = below(capacity - int(least)), int(np.searchsorted(s, least))
        room = (alone - half) * capacity - int(total[alone] - total[half])
        best = max(best, len(s) - half + max(0, -((room - int(total[half] - total[first])) // capacity)))
    return best


def completion(room: int, items: list[int], sizes: list[int]) -> list[int]:
    """The items whose sizes add up closest to ``room`` from below; sums are bits of an integer."""
    mask, reach = (1 << (room + 1)) - 1, [1]
    for i in items:
        reach.append((reach[-1] | (reach[-1] << sizes[i])) & mask)
        if reach[-1] >> room:
            break
    at, taken = reach[-1].bit_length() - 1, []
    for k in range(len(reach) - 1, 0, -1):
        if not (reach[k - 1] >> at) & 1:
            taken.append(items[k - 1])
            at -= sizes[items[k - 1]]
    return taken


class Island:
    """A small population on the items of one block; a person is (containers, how full each is)."""

    def __init__(self, sizes: list[int], capacity: int, seed: int) -> None:
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)
        self.bound = max(1, lower_bound(sizes, capacity))
        self.people: list[tuple[list[list[int]], list[int]]] = []

    def add(self, bins: list[list[int]]) -> tuple[list[list[int]], list[int]]:
        self.people.append((bins, [sum(self.sizes[i] for i in b) for b in bins]))
        return self.people[-1]

    def fitness(self, person: tuple[list[list[int]], list[int]]) -> tuple[int, int]:
        """Fewer containers first, then unevenly filled ones: full beside nearly empty."""
        return (-len(person[1]), sum(f * f for f in person[1]))

    def best(self) -> tuple[list[list[int]], list[int]]:
        return max(self.people, key=self.fitness)

    def solved(self) -> bool:
        return bool(self.people) and len(self.best()[0]) <= self.bound

    def found(self, size: int) -> None:
        """Best fit, the largest first; then orders that are shuffled within neighbourhoods of size."""
        while len(self.people) < size and not self.solved():
            noise = (lambda i: 1.0) if not self.people else (lambda i: self.rng.uniform(0.9, 1.1))
            self.add(best_fit(sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i] * noise(i), i)), self.sizes, self.capacity, []))

    def swap_in(self, loose: list[int], bins: list[list[int]], fills: list[int]) -> list[int]:
        """Put one or two loose items for one or two (or none) of a container, where it gets fuller; what is loose then."""
        sizes = self.sizes

        def pool() -> tuple[list[tuple[int, tuple[int, ...]]], list[int]]:
            some = [(sizes[i], (i,)) for i in loose] + [(sizes[i] + sizes[j], (i, j)) for n, i in enumerate(loose) for j in loose[n + 1 :]]
            some.sort()
            return some, [size for size, _ in some]

        some, keys = pool()
        open_ = [k for k, f in enumerate(fills) if f < self.capacity]
        self.rng.shuffle(open_)
        for k in open_:
            held, room, best = bins[k], self.capacity - fills[k], (0, (), ())
            out = [((), 0), *[((i,), sizes[i]) for i in held]]
            out += [((held[x], held[y]), sizes[held[x]] + sizes[held[y]]) for x in range(min(4, len(held))) for y in range(x + 1, min(4, len(held)))]
            for gone, size in out:
                at = bisect.bisect_right(keys, size + room) - 1
                if at >= 0 and keys[at] - size > best[0]:
                    best = (keys[at] - size, gone, some[at][1])
                    if best[0] == room:
                        break
            gain, gone, into = best
            if gain:
                bins[k] = [i for i in held if i not in gone] + list(into)
                fills[k] += gain
                loose = [i for i in loose if i not in into] + list(gone)
                some, keys = pool()
        return loose

    def refit(self, loose: list[int], bins: list[list[int]], fills: list[int], most: int = 40) -> tuple[list[list[int]], list[int]]:
        """The displaced items back into the containers, in one of the two ways."""
        sizes, capacity = self.sizes, self.capacity
        if len(loose) <= 24:
            loose = sorted(self.swap_in(loose, bins, fills), key=lambda i: (-sizes[i], i))
            packed = best_fit(loose, sizes, capacity, bins)
            return packed, [sum(sizes[i] for i in b) if n >= len(bins) or len(b) != len(bins[n]) else fills[n] for n, b in enumerate(packed)]
        noise = self.rng.choice((0.0, 0.1))
        left = sorted(loose, key=lambda i: (-sizes[i] * (1 + noise * self.rng.random()), i))
        while left:
            first, left = left[0], left[1:]
            room, taken = capacity - sizes[first], []
            if room > 0:
                fit = [i for i in left if sizes[i] <= room]
                if len(fit) > most:
                    fit = sorted(fit[: most // 2] + self.rng.sample(fit[most // 2 :], most // 2), key=lambda i: (-sizes[i], i))
                taken = completion(room, fit, sizes)
                out = set(taken)
                left = [i for i in left if i not in out]
            bins.append([first, *taken])
            fills.append(sizes[first] + sum(sizes[i] for i in taken))
        return bins, fills

    def without(self, person: tuple[list[list[int]], list[int]], gone: set[int]) -> tuple[list[int], list[list[int]], list[int]]:
        bins, fills = person
        return [i for k in gone for i in bins[k]], [b for k, b in enumerate(bins) if k not in gone], [f for k, f in enumerate(fills) if k not in gone]

    def cross(self, one: tuple[list[list[int]], list[int]], two: tuple[list[list[int]], list[int]]) -> tuple[list[list[int]], list[int]]:
        order = sorted(range(len(two[0])), key=lambda k: -two[1][k])[: max(1, len(two[0]) // 2)]
        gift = self.rng.sample(order, min(len(order), self.rng.randint(1, 20)))
        given = {i for k in gift for i in two[0][k]}
        loose, bins, fills = self.without(one, {k for k, b in enumerate(one[0]) if not given.isdisjoint(b)})
        return self.refit([i for i in loose if i not in given], bins + [list(two[0][k]) for k in gift], fills + [two[1][k] for k in gift])

    def mutate(self, person: tuple[list[list[int]], list[int]]) -> tuple[list[list[int]], list[int]]:
        bins, fills = person
        order = sorted((k for k, f in enumerate(fills) if f < self.capacity), key=lambda k: fills[k])
        n = self.rng.choice((3, 10, 20, 40))
        gone = {*order[: max(1, n // 2)], *self.rng.sample(order, min(len(order), n // 2)), *self.rng.sample(range(len(bins)), min(len(bins), n))}
        return self.refit(*self.without(person, gone))

    def evolve(self, generations: int, size: int) -> None:
        self.found(size)
        for _ in range(generations):
            if self.solved():
                return
            parent = self.best() if self.rng.random() < 0.7 else self.rng.choice(self.people)
            child = self.cross(parent, self.rng.choice(self.people)) if self.rng.random() < 0.2 else self.mutate(parent)
            if self.fitness(child) >= self.fitness(min(self.people, key=self.fitness)):
                self.people = sorted([child, *self.people], key=self.fitness, reverse=True)[:size]


_ITEM = "profile string, capacity int, block long, island int, item long, doc_id long, piece int, size int"


def _round(rows: DataFrame, generations: int, population: int) -> DataFrame:
    """Evolve every island from its elites (``bin_0``: its own, ``bin_1``: the migrant)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        island = Island(pdf["size"].tolist(), int(pdf["capacity"].iloc[0]), hash((int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0]))) & 0x7FFFFFFF)
        for column in ("bin_0", "bin_1"):
            if pdf[column].iloc[0] >= 0:
                groups: dict[int, list[int]] = {}
                for i, b in enumerate(pdf[column].tolist()):
                    groups.setdefault(b, []).append(i)
                island.add(list(groups.values()))
        island.evolve(generations, population)
        best = island.best()
        place = [0] * len(pdf)
        for k, b in enumerate(best[0]):
            for i in b:
                place[i] = k
        count, even = island.fitness(best)
        out = pdf[["profile", "capacity", "block", "island", "item", "doc_id", "piece", "size"]].copy()
        return out.assign(bin=place, bins=-count, evenness=float(even))

    return rows.groupBy("profile", "block", "island").applyInPandas(run, f"{_ITEM}, bin int, bins int, evenness double")


def _pack_blocks(items: DataFrame, islands: int, rounds: int, generations: int, population: int) -> DataFrame:
    """``items(profile, capacity, block, item, doc_id, piece, size)`` -> the same with ``bin``, numbered within the block."""
    state = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumns({"bin_0": F.lit(-1), "bin_1": F.lit(-1)})
    for nth in range(rounds):
        elites = materialise(_round(state, generations, population), "elites")
        if nth + 1 < rounds:
            migrant = elites.select("profile", "block", ((F.col("island") + 1) % islands).alias("island"), "item", F.col("bin").alias("bin_1"))
            state = elites.withColumnRenamed("bin", "bin_0").drop("bins", "evenness").join(migrant, ["profile", "block", "island", "item"])
    chosen = elites.groupBy("profile", "block").agg(F.max_by("island", F.struct(-F.col("bins"), "evenness", -F.col("island"))).alias("island"))
    return elites.join(chosen, ["profile", "block", "island"]).select("profile", "capacity", "block", "item", "doc_id", "piece", "size", "bin")


def pack_texts(
    documents: DataFrame, limits: list[tuple[str, int]], vocabulary: str = VOCABULARY, block_items: int = 2000, islands: int = 2, rounds: int = 2, generations: int = 60, population: int = 4, well_filled: float = 0.97
) -> DataFrame:
    """``documents(doc_id, text)`` -> (profile, doc_id, piece, tokens, container_id).

    ``limits`` are the (profile, capacity in tokens) to pack for.  Pieces of a
    document are numbered from 0; container_id is unique within a profile.
    """
    counted = materialise(with_token_counts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary=vocabulary), "tokens")
    return pack_sizes(counted, limits, block_items, islands, rounds, generations, population, well_filled)


def pack_sizes(counted: DataFrame, limits: list[tuple[str, int]], block_items: int = 2000, islands: int = 2, rounds: int = 2, generations: int = 60, population: int = 4, well_filled: float = 0.97) -> DataFrame:
    """``pack_texts`` of ``counted(doc_id, tokens)``; without generations, best fit alone."""
    limits = [(p, int(c)) for p, c in limits if p is not None and c is not None]
    if any(c < 1 for _, c in limits):
        raise ValueError("a capacity must be at least one token")
    spark = counted.sparkSession
    profiles = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity")) for p, c in limits]) if limits else None
    if profiles is None:
        return spark.createDataFrame([], "profile string, doc_id long, piece int, tokens int, container_id string")
    wide = with_copies(counted, "item").select("item", "doc_id", "tokens", F.inline(profiles))
    none = wide.filter("tokens is null").select("profile", "doc_id", F.lit(0).alias("piece"), "tokens", F.lit(None).cast("string").alias("container_id"))
    wide = wide.filter("tokens is not null").withColumn("full", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity")).cast("int")).otherwise(0)).withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity"))
    whole = wide.filter("full > 0").select("profile", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.col("capacity").alias("tokens"), "item")
    whole = whole.select("profile", "doc_id", "piece", "tokens", F.concat_ws("-", F.lit("full"), "item", "piece").alias("container_id"))
    loose = materialise(wide.filter("rest > 0 or full = 0").select("profile", "capacity", "item", "doc_id", F.col("full").alias("piece"), F.col("rest").alias("size")), "loose")
    columns = ["profile", "capacity", "item", "doc_id", "piece", "size"]
    placed, level = None, 0
    while True:
        sizes = {r["profile"]: r["count"] for r in loose.groupBy("profile").count().collect()}  # one row a profile
        if not sizes:
            break
        blocks = {p: -(-n // block_items) for p, n in sizes.items()}
        number = F.create_map(*[F.lit(x) for p, b in blocks.items() for x in (p, b)])
        dealt = loose.select(*columns, F.pmod(F.xxhash64("item", F.lit(level)), number[F.col("profile")]).alias("block"))
        packed = materialise(_pack_blocks(dealt, islands, rounds, generations, population), "packed")
        named = packed.withColumn("container_id", F.concat_ws("-", F.lit(f"level{level}"), "block", "bin"))
        done, loose = named, None
        if max(blocks.values()) > 1:
            filled = packed.groupBy("profile", "block", "bin").agg((F.sum("size") >= F.lit(well_filled) * F.first("capacity")).alias("good"))
            judged = named.join(filled, ["profile", "block", "bin"])
            left = materialise(judged.filter("not good").select(*columns), "loose")
            if left.count() <= sum(sizes.values()) // 2:
                done, loose = judged.filter("good"), left
            # else the blocks are alike and their items don't combine: dealing them anew would not help
        done = done.select("profile", "doc_id", "piece", F.col("size").alias("tokens"), "container_id")
        placed = done if placed is None else placed.unionByName(done)
        level += 1
        if loose is None:
            break
    if placed is None:
        return none.unionByName(whole)
    return placed.unionByName(whole).unionByName(none)


def fill_report(packed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """(profile, containers, tokens, bound, filled): containers, those that the tokens need at least, and the share of room used."""
    capacity = F.create_map(*[F.lit(x) for p, c in limits for x in (p, c)])
    placed = packed.filter("container_id is not null").groupBy("profile").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return placed.withColumns({"bound": F.ceil(F.col("tokens") / capacity[F.col("profile")]), "filled": F.col("tokens") / (F.col("containers") * capacity[F.col("profile")])})


def compare_with_best_fit(documents: DataFrame, limits: list[tuple[str, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """(profile, texts, tokens, best_fit, containers, bound, filled): what the genetic steps save over best fit on the same blocks."""
    counted = materialise(with_token_counts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary=vocabulary), "tokens")
    packed = materialise(pack_sizes(counted, limits), "compared")
    plain = fill_report(pack_sizes(counted, limits, islands=1, rounds=1, generations=0, population=1), limits).select("profile", F.col("containers").alias("best_fit"))
    texts = packed.filter("container_id is not null").groupBy("profile").agg(F.count_if(F.col("piece") == 0).alias("texts"))
    return fill_report(packed, limits).join(plain, "profile").join(texts, "profile").select("profile", "texts", "tokens", "best_fit", "containers", "bound", "filled")
