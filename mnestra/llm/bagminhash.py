"""Problem 5: near-duplicate records with small edits.

Method: BagMinHash.  Every word has a weight from a discretised scale (1, 2, 4,
8: the rarer in the corpus, the heavier), and for every register a Poisson process over
the weight axis.  The first point of the whole axis is drawn first; going down
the halves of the axis, a half either holds that point or gets its own later
one.  The least point over all words below their weights is the register, and
two records agree in a register with the probability of their weighted Jaccard
similarity.  Registers are banded; records that meet in a band are verified with
the exact Jaccard similarity of their sets of distinct words.

Points are drawn once per distinct word of a batch, not per record, so that drawing
is a third of the work and stopping it early would save little; the minima are taken
over whole rows of registers.

The weights only steer which records meet.  Most words of any text are frequent
ones, so that with equal weights unrelated records would meet by the million.
Words are weighed by document counts over the whole corpus; the table that is
sent to the tasks holds the words that stand in at least 1/256 of the records,
which are at most 256 times the mean number of distinct words of a record.

The weighted bands alone guarantee nothing for the plain measure: records that
share common words and differ in rare ones seldom meet in them, and a bucket of
more than ``hot_bucket`` classes is not paired.  So records also
meet exactly, in every word of their prefixes: sets with a Jaccard similarity of
at least t share one of their first n - ceil(t n) + 1 words in any fixed order,
and two of their first n - ceil(t n) + 2.  The order is the rarest first, by
counts in ``_CELLS`` cells of word hashes; a word more frequent than ``hot_word``
and than 1/256 of the records is met in by pairs of words.  Sizes, places of the word and the parity of hashed
words bound the overlap before a pair is handed on; no pair above t is lost.  Among
the records of one key only those are compared that share one more word of
their prefixes: 16 bits of each word that follows travel with the key of a word of many records, so that
work grows with the pairs that share two words and not with the square of a key's records.  A key
of more than ``long_key`` records is cut into chunks, and the products of chunks
are spread over tasks.

``multiset`` counts repeated words: the n-th occurrence of a word is an element of its
own, so that the overlap is the sum of the lesser counts over that of the greater ones.

Records with the same set of words are one class and enter the bands once; classes
are named by a 64-bit hash of the set.

Defined results: nulls are left out; values without words are near only to equal
values; repeated ids count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from mnestra.operators.components import connected_components
from mnestra.session import materialise, spread

WORD = re.compile(r"[^\W_]+")
WEIGHT_LEVELS = 3  # weights 1, 2, 4 and 2 ** WEIGHT_LEVELS
_COMMON = (1 / 4, 1 / 32, 1 / 256)  # a word in so large a share of the records weighs 1, 2 or 4, any other 8
PART_ROWS = 500_000
_CELLS = 2**18
_BLOCK = 2**20
_PARITY, _SMALL = tuple(f"parity_{n}" for n in range(4)), 64
_WIDE = 256  # a set of more words is compared with all of a key, its following words would be too many
_FEW = 12  # and so is one in the key of a word that stands in fewer records than so many for every following word


def word_elements(value: Column) -> Column:
    """Hashes of the distinct words of a value, in the order of the hashes."""
    words = F.array_distinct(F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


@F.pandas_udf(ArrayType(LongType()))
def counted_elements(values: pd.Series) -> pd.Series:
    """Hashes of the words of a value with the number of the occurrence, so that repeated words count."""

    def of(value: str) -> list[int]:
        seen: Counter = Counter()
        out = []
        for word in WORD.findall(value.lower()):
            out.append(xxhash.xxh64_intdigest(word, seed=seen[word]) - 2**63)
            seen[word] += 1
        return sorted(out)

    return values.map(of)


def _lists(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists, and how many each row has."""
    column = batch.column(at)
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _rows_of(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_lists`` of some rows."""
    begins, more = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
    at = np.repeat(begins - (np.cumsum(more) - more), more) + np.arange(int(more.sum()))
    return flat[at], more


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after the other."""
    return flat[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of 16-bit numbers as a column of bytes."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(2 * sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, np.uint16))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_binary`` read again: the numbers, where each run begins, and its size."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint16, len(data) // 2) if data is not None else np.empty(0, np.uint16)
    return flat[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def _pairs_of_runs(length: np.ndarray, first: np.ndarray | bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within consecutive runs of these lengths, about ``_BLOCK`` at a time; only those of which the earlier one is a ``first``."""
    ends = np.cumsum(length)
    later = np.where(first, np.repeat(ends, length) - np.arange(int(length.sum())) - 1, 0)
    total = np.cumsum(later)
    lo = 0
    while lo < len(later):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _BLOCK, "right")))
        some = later[lo:hi]
        i = np.repeat(np.arange(lo, hi), some)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        lo = hi


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_points(words: np.ndarray, level: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """First point of each word's process below weight ``2 ** level``, by register.

    The process over [0, 2 ** WEIGHT_LEVELS) has rate 1 per unit of weight.
    """
    seeds = _mix(words.view(np.uint64)[:, None] + _mix(registers.astype(np.uint64) + np.uint64(1))[None, :])

    def waits(s: np.ndarray, rate: int) -> np.ndarray:
        return -np.log(((s >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate

    points = waits(seeds, 2**WEIGHT_LEVELS)
    for depth in range(1, WEIGHT_LEVELS + 1):
        below = np.flatnonzero(level <= WEIGHT_LEVELS - depth)
        if not len(below):
            break
        drawn = _mix(seeds[below] + np.uint64(depth * 0x9E3779B97F4A7C15 % 2**64))
        upper = (drawn & np.uint64(1)).astype(bool)  # the point lies in the upper half: the lower half's first comes later
        points[below] += np.where(upper, waits(_mix(drawn), 2 ** (WEIGHT_LEVELS - depth)), 0.0)
    return points


def signatures(flat: np.ndarray, sizes: np.ndarray, level_of: dict[int, int], registers: int) -> np.ndarray:
    """Registers of every value; all values must have words."""
    words, where = np.unique(flat, return_inverse=True)
    level = np.array([level_of.get(w, WEIGHT_LEVELS) for w in words.tolist()], np.int64)
    points = np.empty((len(words), registers), np.float32)
    for lo in range(0, len(words), 256):
        points[lo : lo + 256] = first_points(words[lo : lo + 256], level[lo : lo + 256], np.arange(registers))
    begins, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    out = np.empty((len(sizes), registers), np.float32)
    for lo in range(0, len(order), 128):
        some = order[lo : lo + 128]  # the largest first, so that those with a j-th word are a head of the block
        begin, n = begins[some], sizes[some]
        low = points[where[begin]]
        for j in range(1, int(n[0])):
            head = int(np.searchsorted(-n, -j))
            np.minimum(low[:head], points[where[begin[:head] + j]], out=low[:head])
        out[some] = low
    return out


def _word_levels(values: DataFrame) -> tuple[dict[int, int], np.ndarray, int, int]:
    """The weights (as powers of two) of the words that stand in many records, counts of words by cell of their hash, all words, and the records."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = np.unique(_lists(batch, 0)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(words, 0)), pa.array(np.append(times, 0)), pa.array(np.append(np.zeros(len(words), np.int64), batch.num_rows))],
                names=["word", "times", "records"],
            )

    counted = values.select("words").mapInArrow(count, "word long, times long, records long").groupBy("word").agg(F.sum("times").alias("times"), F.sum("records").alias("records"))
    counted = materialise(counted.filter("times > 0 or records > 0"), "word-counts", clean=True)
    records, total = counted.agg(F.sum("records"), F.sum("times")).first()
    records = records or 0
    common = counted.filter(F.col("times") >= _COMMON[-1] * max(records, 1)).select("word", "times").collect()
    levels = {r["word"]: next(i for i, share in enumerate(_COMMON) if r["times"] >= share * records) for r in common}
    cells = counted.groupBy(F.pmod("word", F.lit(_CELLS)).cast("int").alias("cell")).agg(F.sum("times").alias("times")).toArrow()
    often = np.zeros(_CELLS, np.int64)
    often[cells["cell"].to_numpy()] = cells["times"].to_numpy()
    return levels, often, total or 0, records


def _dealt(rows: DataFrame, key: str, about: int) -> DataFrame:
    """Rows parted by a key, in as many parts as about so many rows need, and sorted."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-about // PART_ROWS))
    return rows.repartition(parts, key).sortWithinPartitions(key, "kind")


def _buckets(values: DataFrame, level_of, bands: int, rows: int) -> DataFrame:
    """``values(kind, field, words)`` -> the buckets of every class, a row a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # a class once per batch
            field = batch.column(1).to_numpy()[first].view(np.uint64)
            flat, sizes = _rows_of(*_lists(batch, 2), first)
            kind, field, sizes = kind[sizes > 0], field[sizes > 0], sizes[sizes > 0]
            if not len(kind):
                continue
            signature = signatures(flat, sizes, level_of.value, bands * rows).view(np.uint32).astype(np.uint64)
            for band in range(bands):
                key = field + np.uint64(band)
                for register in range(band * rows, (band + 1) * rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, register])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind)], names=["bucket", "kind"])

    return values.mapInArrow(run, "bucket long, kind long")


def _pairs_in_runs(sorted_rows: DataFrame, hot: int) -> DataFrame:
    """From rows sorted by (bucket, kind): the pairs of kinds in a bucket that holds at most ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kinds = np.empty(0, np.int64), np.empty(0, np.int64)
        passed: int | None = None  # a bucket found too large, which goes on

        def whole(keys: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            length = np.diff(np.concatenate([begin, [len(keys)]]))
            fine = np.repeat(length <= hot, length)
            keys, kinds = keys[fine], kinds[fine]
            for step in range(1, hot):
                near = np.flatnonzero(keys[step:] == keys[:-step])
                if not len(near):
                    break
                yield pa.RecordBatch.from_arrays([pa.array(kinds[near]), pa.array(kinds[near + step])], names=["a", "b"])

        for batch in batches:
            keys, kinds = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([kinds, batch.column(1).to_numpy()])
            if passed is not None:
                keys, kinds = keys[keys != passed], kinds[keys != passed]
            if not len(keys):
                continue
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])])
            keys, kinds, passed = keys[fresh], kinds[fresh], None
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield from whole(keys[:end], kinds[:end])
            keys, kinds = keys[end:], kinds[end:]
            if len(keys) > hot:
                passed = int(keys[0])
                keys, kinds = keys[:0], kinds[:0]
        if len(keys):
            yield from whole(keys, kinds)

    return sorted_rows.mapInArrow(run, "a long, b long")


def _prefix_keys(values: DataFrame, often, threshold: float, hot_word: int) -> DataFrame:
    """The keys in which a record meets others exactly: the words of its prefix, and pairs of words instead of hot ones.

    ``place`` is the size of the set and the place of the (first) word in it, or the one before that of the second word;
    ``parity_n`` are bits of which every word turns one: 256 for a large set, for a small one these folded into the first 64.
    ``rest`` holds 16 bits of each word that can be the next one shared, and a zero where nothing more need be shared; where
    it is empty, the record is to be compared with all of its key.  Words of one record are no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, of: np.ndarray, last: np.ndarray, held: int) -> pa.RecordBatch:
            """``last``: the last word of the key, of ``held`` words."""
            follow = np.minimum(prefix[of] + held - 1, sizes[of] - 1) - at[last]
            bare = (sizes[of] > _WIDE) | ((times[last] <= _FEW * follow) & (held == 1))
            alone = (least[of] <= held) & ~bare
            more = np.where(bare, 0, follow + alone)
            rest = _gather(short, last + 1, more)
            rest[(np.cumsum(more) - 1)[alone]] = 0
            place = sizes[of] << 32 | (at[last] + 1 - held)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind[of]), pa.array(place), *[pa.array(p[of].view(np.int64)) for p in parity], _binary(rest, more)], names=["key", "kind", "place", *_PARITY, "rest"])

        for batch in batches:
            kind, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            field = batch.column(1).to_numpy()[first].view(np.uint64)
            flat, sizes = _rows_of(*_lists(batch, 2), first)
            kind, field, sizes = kind[sizes > 0], field[sizes > 0], sizes[sizes > 0]
            if not len(kind):
                continue
            begins = np.cumsum(sizes) - sizes
            of = np.repeat(np.arange(len(sizes)), sizes)
            times = often.value[flat % _CELLS]
            order = np.lexsort((flat, times, of))
            words, times, at = _mix(flat[order].view(np.uint64)), times[order], np.arange(len(flat)) - begins[of]
            short = np.append((words >> np.uint64(8)) % np.uint64(2**16 - 1) + np.uint64(1), np.uint64(0)).astype(np.uint16)
            turned, quarter = np.uint64(1) << (words >> np.uint64(58)), words & np.uint64(3)
            quarter[np.repeat(sizes <= _SMALL, sizes)] = 0
            parity = [np.bitwise_xor.reduceat(np.where(quarter == n, turned, np.uint64(0)), begins) for n in range(len(_PARITY))]
            least = np.ceil(threshold * sizes - 1e-9).astype(np.int64)  # words shared with any partner
            prefix = sizes - least + 1
            inside, hot = at < prefix[of], times > hot_word
            keys = _mix(words + field[of])
            one = np.flatnonzero(inside & (times > 1) & (~hot | (least[of] <= 1)))
            if len(one):
                yield out(keys[one], of[one], one, 1)
            two = np.flatnonzero(inside & hot)
            follow = np.minimum(prefix, sizes - 1)[of[two]] - at[two]
            part = (np.cumsum(follow) // _BLOCK) if len(two) else follow
            for n in np.unique(part):
                some, more = two[part == n], follow[part == n]
                if not more.sum():
                    continue
                i = np.repeat(some, more)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
                yield out(_mix(keys[i] * np.uint64(0x9E3779B97F4A7C15) + words[j]), of[i], j, 2)

    return values.mapInArrow(run, f"key long, kind long, place long, {' long, '.join(_PARITY)} long, rest binary")


_MET = f"a long, b long, key long, place long, {' long, '.join(_PARITY)} long, rest binary"


def _meet_exactly(sorted_rows: DataFrame, threshold: float, long_key: int | None) -> DataFrame:
    """From rows sorted by (key, kind): the pairs of kinds of a key that share one more word of their prefixes, and that
    sizes, places and parities do not rule out.

    The rows of a key that has more than ``long_key`` come back as they are, with a null ``b``.  Rows with a column
    ``side`` only meet rows of another side, those of side -1 all.
    """
    sided = "side" in sorted_rows.columns
    fixed = ["key", "kind", "place", *_PARITY, *["side"] * sided]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [pa.int64()] * (2 + len(_PARITY)) + [pa.binary()]
        names = ["a", "b", "key", "place", *_PARITY, "rest"]

        def as_they_are(rows: list[np.ndarray], rest: np.ndarray) -> pa.RecordBatch:
            own = _binary(_gather(rest, rows[-2], rows[-1]), rows[-1])
            return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(len(rows[1]), pa.int64()), *[pa.array(c) for c in (rows[0], *rows[2 : 3 + len(_PARITY)])], own], names=names)

        def pairs(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, passed_a: np.ndarray | int = 0, passed_b: np.ndarray | int = 0) -> np.ndarray:
            """Those of the pairs of rows that may be near, as one number each; ``passed``: words of the rest before the shared one."""
            x, y = rows[2][a], rows[2][b]
            sum_of = (x >> 32) + (y >> 32)
            needed = np.ceil(threshold / (1 + threshold) * sum_of - 1e-9).astype(np.int64)
            good = np.minimum((x >> 32) - (x & 0xFFFFFFFF) - passed_a, (y >> 32) - (y & 0xFFFFFFFF) - passed_b) >= needed
            if sided:
                side = rows[3 + len(_PARITY)]
                good &= (side[a] != side[b]) | (side[a] < 0)
            a, b, apart = a[good], b[good], (sum_of - 2 * needed)[good]
            turned = [(p[a] ^ p[b]).view(np.uint64) for p in rows[3 : 3 + len(_PARITY)]]
            both_large = np.minimum(rows[2][a] >> 32, rows[2][b] >> 32) > _SMALL
            folded = np.bitwise_count(np.bitwise_xor.reduce(turned)).astype(np.int64)
            good = np.where(both_large, sum(np.bitwise_count(t).astype(np.int64) for t in turned), folded) <= apart
            a, b = a[good], b[good]
            return np.unique(np.minimum(a, b) << 32 | np.maximum(a, b))

        def near(rows: list[np.ndarray], rest: np.ndarray) -> Iterator[np.ndarray]:
            """Pairs of rows of whole runs of keys."""
            run_of = np.cumsum(np.concatenate([[0], (rows[0][1:] != rows[0][:-1]).astype(np.int64)]))
            size, owner = rows[-1], np.repeat(np.arange(len(rows[0])), rows[-1])
            passed = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            shared = _gather(rest, rows[-2], size).astype(np.int64)
            passed[shared == 0] = 0
            order = np.sort((run_of[owner] << 16 | shared) << 27 | np.arange(len(owner)))
            met, order = order >> 27, order & (2**27 - 1)
            owner, passed = owner[order], passed[order]
            begin = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]])) if len(met) else np.empty(0, np.int64)
            for i, j in _pairs_of_runs(np.diff(np.append(begin, len(met)))):
                apart = owner[i] != owner[j]
                i, j = i[apart], j[apart]
                yield pairs(rows, owner[i], owner[j], passed[i], passed[j])
            if not size.all():  # those that carry no words come first and meet all that follow
                order = np.lexsort((size > 0, run_of))
                begin = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
                for i, j in _pairs_of_runs(np.diff(np.append(begin, len(order))), size[order] == 0):
                    yield pairs(rows, order[i], order[j])

        def whole(rows: list[np.ndarray], rest: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
            length = np.diff(np.append(begin, len(rows[0])))
            if long_key is not None and (length > long_key).any():
                far = np.repeat(length > long_key, length)
                yield as_they_are([c[far] for c in rows], rest)
                rows, length = [c[~far] for c in rows], length[length <= long_key]
            several = np.repeat(length > 1, length)
            rows, length = [c[several] for c in rows], length[length > 1]
            ends = np.cumsum(length)
            lo = 0
            words = np.cumsum(rows[-1])
            for hi in ends[np.flatnonzero(np.diff(np.append(words[ends - 1] // _BLOCK, -1)))] if len(ends) else ():  # whole runs, about _BLOCK words at a time
                some = [c[lo:hi] for c in rows]
                for found in near(some, rest):
                    if len(found):
                        a, b = some[1][found >> 32], some[1][found & 0xFFFFFFFF]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *[pa.nulls(len(a), t) for t in nothing]], names=names)
                lo = hi

        def joined(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
            """One row for each kind of a key."""
            before = np.cumsum([0, *[len(rest) for _, rest in parts]])
            rows = [np.concatenate(c) for c in zip(*[[*rows[:-2], rows[-2] + n, rows[-1]] for (rows, _), n in zip(parts, before)])]
            fresh = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            return [c[fresh] for c in rows], np.concatenate([rest for _, rest in parts])

        waiting: list[tuple[list[np.ndarray], np.ndarray]] = []  # rows of one key that goes on
        passing: int | None = None  # a key too long, whose rows go on as they are
        for batch in batches:
            rest, begins, sizes = _numbers(batch.column(batch.schema.get_field_index("rest")))
            new = [*[batch.column(batch.schema.get_field_index(c)).to_numpy() for c in fixed], begins, sizes]
            if passing is not None:
                mine = new[0] == passing
                if mine.any():
                    yield as_they_are([c[mine] for c in new], rest)
                    new = [c[~mine] for c in new]
            if not len(new[0]):
                continue
            passing = None
            if waiting and new[0][-1] == waiting[0][0][0][0] and sum(len(w[0][0]) for w in waiting) + len(new[0]) <= (long_key or 2**62):
                waiting.append((new, rest))
                continue
            held, rest = joined([*waiting, (new, rest)])
            end = int(np.searchsorted(held[0], held[0][-1]))
            if end:
                yield from whole([c[:end] for c in held], rest)
            tail = [c[end:] for c in held]
            rest = _gather(rest, tail[-2], tail[-1])
            tail[-2] = np.cumsum(tail[-1]) - tail[-1]
            waiting = [(tail, rest)]
            if long_key is not None and len(tail[0]) > long_key:
                passing = int(tail[0][0])
                yield as_they_are(tail, rest)
                waiting = []
        if waiting:
            yield from whole(*joined(waiting))

    return sorted_rows.mapInArrow(run, _MET)


def _meet_in_chunks(rows: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """The pairs of long keys: their rows are cut into chunks by hash, and every pair of chunks is met on its own."""
    rows = materialise(rows.select("key", F.col("a").alias("kind"), "place", *_PARITY, "rest").distinct(), "long-keys", clean=True)
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    own = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("kind", F.lit(1)), F.col("chunks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long")
    product = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    sided = met.select(product.alias("key"), "kind", "place", *_PARITY, "rest", side.alias("side"))
    return _meet_exactly(sided.repartition("key").sortWithinPartitions("key", "kind"), threshold, None)


def near_duplicates(
    records: DataFrame, threshold: float = 0.7, bands: int = 28, rows: int = 5, hot_bucket: int = 256, hot_word: int = 4096, long_key: int = 100_000, multiset: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Links between different sets of words, and the records of each set.

    ``records(field_name, id, value)`` -> ``links(a, b)`` between kinds (classes
    of equal sets in one field) with a Jaccard similarity of at least
    ``threshold``, and ``members(kind, field_name, id)``.
    """
    spark = records.sparkSession
    values = spread(records.select("field_name", F.col("id").cast("long").alias("id"), "value").filter("id is not null and value is not null"))
    words = (counted_elements if multiset else word_elements)(F.col("value"))
    field = F.xxhash64("field_name")
    read = values.select("field_name", "id", field.alias("field"), "value", words.alias("words"))
    kind = F.when(F.size("words") > 0, F.xxhash64("field", "words")).otherwise(F.xxhash64("field", F.lit("value"), "value"))
    read = materialise(read.select("field_name", "id", "field", kind.alias("kind"), "words"), "words")
    members, sets = read.select("kind", "field_name", "id"), read.select("kind", "field", "words")
    levels, often, total, records_read = _word_levels(read)
    level_of, often = spark.sparkContext.broadcast(levels), spark.sparkContext.broadcast(often)
    buckets = _dealt(_buckets(sets, level_of, bands, rows), "bucket", members.count() * bands)
    pairs = _pairs_in_runs(buckets, hot_bucket)
    keys = _dealt(_prefix_keys(sets, often, threshold, max(hot_word, int(_COMMON[-1] * records_read))), "key", total)
    exact = materialise(_meet_exactly(keys, threshold, long_key), "met", clean=True)
    pairs = pairs.unionByName(exact.filter("b is not null").select("a", "b"))
    far = exact.filter("b is null")
    if far.limit(1).count():
        pairs = pairs.unionByName(_meet_in_chunks(far, threshold, max(1, min(4096, long_key // 2))).select("a", "b"))
    pairs = materialise(pairs.distinct(), "pairs", clean=True)
    involved = pairs.select(F.col("a").alias("kind")).union(pairs.select(F.col("b").alias("kind"))).distinct()
    texts = materialise(sets.select("kind", "words").join(involved, "kind", "left_semi").dropDuplicates(["kind"]), "involved", clean=True)
    left, right = texts.toDF("a", "words_a"), texts.toDF("b", "words_b")
    both = F.size(F.array_intersect("words_a", "words_b"))
    either = F.size("words_a") + F.size("words_b") - both
    small, large = F.least(F.size("words_a"), F.size("words_b")), F.greatest(F.size("words_a"), F.size("words_b"))
    links = pairs.join(left, "a").join(right, "b").filter((small >= F.lit(threshold - 1e-12) * large) & (both / either >= F.lit(threshold - 1e-12))).select("a", "b")
    return links, members


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(field_name, id_1, id_2), id_1 < id_2: all pairs, of equal values too."""
    links, members = near_duplicates(records, threshold, **options)
    members = members.distinct()
    repeated = members.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", F.col("kind").alias("a"))
    equal = repeated.select("kind", F.col("kind").alias("other"))
    classes = links.select(F.col("a").alias("kind"), F.col("b").alias("other")).unionByName(equal)
    first = classes.join(members, "kind").select("other", "kind", "field_name", F.col("id").alias("id_a"))
    second = members.select(F.col("kind").alias("other"), F.col("id").alias("id_b"))
    return first.join(second, "other").filter("kind <> other or id_a < id_b").select("field_name", F.least("id_a", "id_b").alias("id_1"), F.greatest("id_a", "id_b").alias("id_2"))


def near_duplicate_groups(records: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """(field_name, id, group_id, links): one row per record; group_id is the least id of its group.

    ``links`` counts the other sets of words that the record's set is near to; copies of it are not counted.
    """
    links, members = near_duplicates(records, threshold, **options)
    links, members = materialise(links, "links"), members.distinct()
    component = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "kind")
    degree = links.select(F.col("a").alias("kind")).union(links.select("b")).groupBy("kind").agg(F.count(F.lit(1)).alias("links"))
    placed = members.join(component, "kind", "left").join(degree, "kind", "left").withColumn("group", F.coalesce("component", "kind"))
    least = placed.groupBy("group").agg(F.min("id").alias("group_id"))
    return placed.join(least, "group").select("field_name", "id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
