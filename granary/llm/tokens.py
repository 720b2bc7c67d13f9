"""Counting tokens of a public tokenizer.

The vocabulary file is a parameter: its path comes from the argument, else from
the environment variable GRANARY_TOKENIZER, else from /opt/tokenizers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The pattern that splits text before the merges of the byte-level rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def vocabulary(path: str | None = None) -> str:
    """The path of the vocabulary file in use."""
    return path or os.environ.get("GRANARY_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoding(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc, source, n_tokens) of ``docs(doc, source, text)``; null texts are left out, empty ones have 0."""
    file = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file).encode_ordinary
        for b in batches:
            n = [len(enc(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc", "source", "n_tokens"])

    some = docs.select("doc", "source", "text").where("doc is not null and text is not null")
    return some.mapInArrow(run, "doc long, source string, n_tokens long")
