"""Sizes in tokens of a public byte-level BPE tokenizer.

The vocabulary is read on each worker from a folder that is a parameter; nothing of it is kept in this repository. Null text
counts 0 tokens. Text is encoded whole.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .common import TOKENIZERS

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tiktoken encoding of a vocabulary file, once per process."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(folder, "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(Path(folder, vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column, as an Arrow UDF."""

    @arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            yield pa.array([0 if t is None else len(encode(t)) for t in batch.to_pylist()], pa.int32())

    return count(text)


def token_pieces(text: str, capacity: int, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of pieces of at most capacity tokens, cut before a word where there is one in reach.

    A cut falls on a token boundary that is also a character boundary, so the pieces' tokens are those of the whole text.
    """
    enc = encoding(folder, vocabulary)
    ids = enc.encode_ordinary(text)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))]
    _, at = enc.decode_with_offsets(ids)
    at.append(len(text))
    whole = [k for k in range(len(ids)) if at[k] != at[k - 1]] if ids else []
    whole_set = set(whole)
    out, k = [], 0
    while len(ids) - k > capacity:
        end = next((j for j in range(k + capacity, k + capacity // 2, -1) if j in whole_set and at[j] < len(text) and text[at[j]].isspace()), 0)
        end = end or next((j for j in range(k + capacity, k, -1) if j in whole_set), k + capacity)
        out.append((at[k], at[end], end - k))
        k = end
    out.append((at[k], len(text), len(ids) - k))
    return out
