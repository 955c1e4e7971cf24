"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, one per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("cairnstat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = VOCABULARY, keep: list[str] = ()) -> DataFrame:
    """(key, keep..., n_tokens): the number of tokens of every whole text, 0 where it is NULL or empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sizes, pa.int64())], names=[*b.schema.names[1:], "n_tokens"])

    cols = df.select(F.col(text).cast("string").alias("__text"), F.col(key), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[1:])
    return cols.mapInArrow(count, f"{fields}, n_tokens bigint")
