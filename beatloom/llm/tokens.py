"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    """One encoder for each vocabulary and Python worker."""
    key = hash(raw)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(df: DataFrame, keys: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens`` of each row's whole text; 0 for null.

    The vocabulary file (about 1 MB whatever the data) is read once, on the driver, and travels with the tasks.
    """
    raw = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    schema = df.select(*keys).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(raw.value).encode_ordinary
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "n_tokens"])

    return df.select(*keys, text).mapInArrow(count, schema)
