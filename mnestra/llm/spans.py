"""Problem 8: long exact spans shared between records.

Method: prefix-partitioned suffix trees.  A span of ``min_chars`` characters
that stands in two texts holds, at the same place in both, the least of its
``prefix_chars``-gram hashes, so only the suffixes that start at such window
minima need to be looked at (about one in fifty).  Suffixes are split by the
hash of their prefix; prefixes of one document alone are dropped before any
text moves.  The suffixes of a prefix, with the characters before them, form two
small trees (sorted suffixes plus longest common prefixes, rightwards and
leftwards).  A pair of nodes, ``d`` characters to the left and ``min_chars - d``
to the right, that holds two documents is a repeat of ``min_chars`` characters;
maximal repeats are unions of these, and so is the part of a text they cover.
Characters are compared, not hashes.

A tree is to fit the memory of its task.  Where a prefix has more than ``hot_rows`` suffixes it is
lengthened: the windows that begin ``lo`` to ``hi`` characters before the suffix all hold the
characters from ``lo`` before it to ``min_chars - hi`` after it, so halving [lo, hi] halves the
characters that the group has not in common.  This goes on until a group is small enough, or
all its suffixes stand in the same characters, or [lo, hi] is one window, which is compared
as a string.

Defined results: null and short texts share nothing; rows repeated under one
doc_id are one document; only doc_id and text are read, so other columns may
have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnestra.session import materialise, spread

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SLICE_CHARS = 1_000_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` code points."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(7919)) * _powers(_BASE, n), out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1))


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbouring keys, by doubling."""
    width, low = 1, keys
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = w - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def window_anchors(texts: list[str], k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, gram hash) of the window minima of some texts.

    Every run of ``span`` characters holds at least one whole gram that is
    chosen, and the choice depends on those characters alone.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    hashes = gram_hashes(points, k)
    w = span - k + 1
    if len(hashes) < w:
        nothing = np.empty(0, np.int64)
        return nothing, nothing, np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(hashes)]
    inside = np.arange(len(hashes)) - starts[owner]
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | inside.astype(np.uint64)
    minima = _window_minima(keys, w)
    owner = owner[: len(minima)]
    whole = inside[: len(minima)] + span <= lengths[owner]
    owner = owner[whole]
    at = (minima[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64) + starts[owner]
    at, first = np.unique(at, return_index=True)
    owner = owner[first]
    return owner, at - starts[owner], hashes[at]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _anchors(documents: DataFrame, k: int, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_pylist()
            for lo, hi in _slices(texts):
                owner, at, hashes = window_anchors(texts[lo:hi], k, span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][owner]), pa.array(marks[lo:hi][owner]), pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))],
                    names=["doc_id", "mark", "pos", "prefix"],
                )

    return documents.mapInArrow(run, "doc_id long, mark long, pos int, prefix long")


def shared_windows(prefix: np.ndarray, doc: np.ndarray, context: list[str], left: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, most characters to the left, least) of the rows in a shared span.

    Rows are suffixes of whole prefix groups.  ``context[i]`` holds ``left[i]``
    characters before the suffix and at most ``span`` of the suffix; windows that begin
    ``lo[i]`` to ``hi[i]`` characters before it are looked at.
    """
    n = len(doc)
    group = np.unique(prefix, return_inverse=True)[1]
    lengths = np.array([len(c) for c in context], np.int64)
    right_length = lengths - left
    points = np.frombuffer("".join(context).encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + left

    def tree(texts: list[str], offset: int, step: int, known: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Row order of a prefix's suffixes and their common lengths with the row before."""
        order = np.array(sorted(range(n), key=lambda i: (group[i], texts[i])), np.int64)
        common = np.zeros(n, np.int64)
        for lo in range(1, n, 4096):
            hi = min(n, lo + 4096)
            a, b = order[lo - 1 : hi - 1], order[lo:hi]
            within = np.minimum(known[a], known[b])
            cols = np.arange(depth)
            inside = cols < within[:, None]
            pick = lambda rows: points[np.where(inside, begin[rows][:, None] + offset + step * cols, 0)]
            differs = (pick(a) != pick(b)) | ~inside
            equal = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
            common[lo:hi] = np.where(group[a] == group[b], equal, -1)
        common[0] = -1
        return order, common

    rights = [c[p:] for c, p in zip(context, left.tolist())]
    lefts = [c[:p][::-1] for c, p in zip(context, left.tolist())]
    right_order, right_common = tree(rights, 0, 1, right_length, span)
    left_order, left_common = tree(lefts, -1, -1, left, max(int(left.max()), 1))
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    right_node, left_node = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        able = np.flatnonzero((left >= d) & (right_length >= span - d) & (lo <= d) & (d <= hi))
        if len(able) < 2:
            continue
        right_node[right_order] = np.cumsum(right_common < span - d)
        left_node[left_order] = np.cumsum(left_common < d)
        node = left_node[able] * (n + 1) + right_node[able]
        by = np.argsort(node, kind="stable")
        node, rows = node[by], able[by]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        several = np.minimum.reduceat(doc[rows], first) < np.maximum.reduceat(doc[rows], first)
        hit = rows[np.repeat(several, np.diff(np.concatenate([first, [len(rows)]])))]
        most[hit] = d
        least[hit[least[hit] < 0]] = d
    found = np.flatnonzero(most >= 0)
    return found, most[found], least[found]


def _spans_of_groups(suffixes: DataFrame, span: int, flush_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> pa.RecordBatch:
            doc = rows.column("doc_id").to_numpy()
            mark = rows.column("mark").to_numpy()
            pos = rows.column("pos").to_numpy().astype(np.int64)
            left, low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("left", "lo", "hi"))
            found, most, least = shared_windows(rows.column("prefix").to_numpy(), doc, rows.column("context").to_pylist(), left, low, high, span)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[found]), pa.array(mark[found]), pa.array((pos[found] - most).astype(np.int32)), pa.array((pos[found] - least + span).astype(np.int32))],
                names=["doc_id", "mark", "begin", "until"],
            )

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < flush_rows:
                continue
            rows = pa.Table.from_batches(kept)
            prefix = rows.column("prefix").to_numpy()
            last = np.flatnonzero(prefix != prefix[-1])
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if whole:
                yield work(rows.slice(0, whole))
            kept = rows.slice(whole).to_batches()
        if kept and sum(b.num_rows for b in kept):
            yield work(pa.Table.from_batches(kept))

    return suffixes.mapInArrow(run, "doc_id long, mark long, begin int, until int")


_SUFFIX = ["prefix", "doc_id", "mark", "pos", "left", "lo", "hi", "context"]


def _lengthened(hot: DataFrame, span: int, hot_rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Suffixes of oversized groups, parted anew by longer prefixes: groups that fit a task, and spans found on the way."""
    fitting, spans = [], []
    while hot.limit(1).count():
        alike = hot.groupBy("prefix").agg(((F.min("context") == F.max("context")) & (F.min("left") == F.max("left"))).alias("alike"))
        judged = materialise(hot.join(alike, "prefix"), "hot")
        right = F.length("context") - F.col("left")
        whole = judged.filter("alike").filter((F.length("context") >= span) & (F.col("left") >= F.col("lo")))
        spans.append(whole.select("doc_id", "mark", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.least(right, F.lit(span) - F.col("lo"))).cast("int").alias("until")))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("hi").alias("h")))
        cut = judged.filter("not alike").select("doc_id", "mark", "pos", "left", "context", F.explode(halves).alias("d")).filter("left >= d.l and length(context) - left >= " + f"{span} - d.h")
        near = F.least(F.col("left"), F.col("d.h"))
        context = F.substring("context", F.col("left") - near + 1, near + F.lit(span) - F.col("d.l"))
        cut = cut.select("doc_id", "mark", "pos", near.alias("left"), F.col("d.l").alias("lo"), F.col("d.h").alias("hi"), context.alias("context"))
        key = F.xxhash64("lo", "hi", F.substring("context", F.col("left") - F.col("lo") + 1, F.col("lo") + F.lit(span) - F.col("hi")))
        cut = materialise(cut.withColumn("prefix", key).select(*_SUFFIX), "cut")
        single = cut.filter("lo = hi")
        shared = single.groupBy("context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("context")
        spans.append(single.join(shared, "context", "left_semi").select("doc_id", "mark", (F.col("pos") - F.col("lo")).alias("begin"), (F.col("pos") - F.col("lo") + F.lit(span)).cast("int").alias("until")))
        sized = cut.filter("lo < hi").groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low < high").select("prefix", (F.col("rows") > hot_rows).alias("hot"))
        parted = materialise(cut.filter("lo < hi").join(sized, "prefix"), "parted")
        fitting.append(parted.filter("not hot").select(*_SUFFIX))
        hot = parted.filter("hot").select(*_SUFFIX)
    return fitting, spans


def _spans(documents: DataFrame, span: int, k: int, hot_rows: int, flush_rows: int) -> DataFrame:
    """(doc_id, mark, spans): overlapping pieces [begin, until) of every text that stand in another document."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    anchors = materialise(_anchors(spread(texts), k, span), "anchors")
    shared = anchors.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low < high").select("prefix", (F.col("rows") > hot_rows).alias("hot"))
    wanted = anchors.join(shared, "prefix").distinct()  # a row repeated m times must not meet itself m * m times
    left = F.least(F.col("pos"), F.lit(span - k))
    context = F.substring("text", F.col("pos") - left + 1, left + F.lit(span))
    suffixes = materialise(wanted.join(texts, ["doc_id", "mark"]).select("prefix", "hot", "doc_id", "mark", "pos", left.alias("left"), F.lit(0).alias("lo"), F.lit(span - k).alias("hi"), context.alias("context")), "suffixes")
    fitting, spans = _lengthened(suffixes.filter("hot").select(*_SUFFIX), span, hot_rows)
    groups = suffixes.filter(~F.col("hot")).select(*_SUFFIX)
    for more in fitting:
        groups = groups.unionByName(more)
    found = _spans_of_groups(groups.repartition("prefix").sortWithinPartitions("prefix"), span, flush_rows)
    for more in spans:
        found = found.unionByName(more)
    return found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("begin", "until"))).alias("spans"))


def shared_spans(documents: DataFrame, min_chars: int = 200, prefix_chars: int | None = None, hot_rows: int = 50_000, flush_rows: int = 16_000) -> DataFrame:
    """Documents with a passage of ``min_chars`` that stands in another one.

    ``documents(doc_id, text)`` -> ``(doc_id, shared_chars)``, where shared_chars
    counts the positions of the text that lie in any such passage.
    """
    merged = _spans(documents, min_chars, prefix_chars or max(1, min_chars // 2), hot_rows, flush_rows)
    covered = F.expr(
        "aggregate(spans, named_struct('chars', 0L, 'upto', 0), (a, s) -> named_struct("
        "'chars', a.chars + greatest(0, s.until - greatest(s.begin, a.upto)), 'upto', greatest(a.upto, s.until)), a -> a.chars)"
    )
    return merged.select("doc_id", covered.alias("chars")).groupBy("doc_id").agg(F.sum("chars").alias("shared_chars"))


def shared_passages(documents: DataFrame, min_chars: int = 200, prefix_chars: int | None = None, hot_rows: int = 50_000, flush_rows: int = 16_000) -> DataFrame:
    """``(doc_id, text_hash, begin, until)``: the parts of every text that are made of shared passages, as large as they get.

    Positions count code points from 0, ``until`` is the first behind; ``text_hash`` tells different texts of one doc_id apart.
    """
    pieces = _spans(documents, min_chars, prefix_chars or max(1, min_chars // 2), hot_rows, flush_rows).select("doc_id", "mark", F.explode("spans").alias("s")).select("doc_id", "mark", "s.begin", "s.until")
    order = Window.partitionBy("doc_id", "mark").orderBy("begin", "until")
    upto = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.withColumn("first", F.when(F.col("begin") <= upto, 0).otherwise(1))
    numbered = starts.withColumn("nth", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "mark", "nth").agg(F.min("begin").alias("begin"), F.max("until").alias("until")).select("doc_id", F.col("mark").alias("text_hash"), "begin", "until")
