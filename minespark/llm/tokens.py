"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the tokenizers' vocabulary files; it must be there on every executor.
TOKENIZER_DIR = os.environ.get("MINESPARK_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(folder: str = TOKENIZER_DIR, ranks: str = RANKS):
    """The byte-level BPE of a rank file, loaded once a process."""
    import base64

    import tiktoken

    path = os.path.join(folder, ranks)
    if path not in _encodings:
        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[path]


def count(enc, text: str | None) -> int:
    """Tokens of a text; NULL and empty texts have none, lone surrogates count as the replacement character."""
    if not text:
        return 0
    return len(enc.encode_ordinary(text.encode("utf-8", "replace").decode() if not text.isprintable() and any("\ud800" <= c <= "\udfff" for c in text) else text))


def token_counts(docs: DataFrame, text: str, keep: list[str], folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """The ``keep`` columns and ``tokens``, the length of the whole text; one pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, ranks)
        for b in batches:
            n = pa.array([count(enc, t) for t in b.column(len(keep)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "tokens"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, tokens bigint")
