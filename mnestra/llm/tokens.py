"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of this vocabulary that parts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``tokens`` (int) in place of its text; null for a null text.

    The vocabulary file is sent to the executors.
    """
    df.sparkSession.sparkContext.addFile(vocabulary)
    others = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(os.path.basename(vocabulary))
        encode = encoding(sent if os.path.exists(sent) else vocabulary).encode_ordinary
        for batch in batches:
            counts = [None if t is None else len(encode(t)) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(counts, pa.int32())], names=[*others, "tokens"])

    return spread(df.select(*others, F.col(text))).mapInArrow(run, f"{schema}{', ' if others else ''}tokens int")


def with_copies(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for every row that does not depend on the order of rows: a hash of the row and of the number of its copy."""
    columns = df.columns
    some = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    tens = some.select(*columns, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 1000))).alias("_k"))
    each = tens.select(*columns, F.explode(F.sequence(F.col("_k") * 1000, F.least(F.col("_k") * 1000 + 999, F.col("_n") - 1))).alias("_copy"))
    return each.select(*columns, F.xxhash64(*columns, "_copy").alias(name))
