"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a file of ranks (base64 token and rank per line), given by its path; its bytes
(below 2 MB) are read once on the driver and broadcast, so executors need no such file.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 16 << 20
#: How the byte-level vocabularies cut text before merging (public with them).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LOADED: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary, built once per Python worker."""
    key = hash(vocabulary)
    if key not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _LOADED.clear()
        _LOADED[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def with_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep`` and ``tokens``: the size of ``text``; 0 if it is null or empty."""
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError("the vocabulary is larger than what may be broadcast")
    shared = df.sparkSession.sparkContext.broadcast(data)
    chosen = df.select(*(F.col(c) for c in (key, *keep)), F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "tokens bigint"])

    def run(batches):
        enc = encoder(shared.value)
        for b in batches:
            size = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int64())], [*b.schema.names[:-1], "tokens"])

    return chosen.mapInArrow(run, schema)
