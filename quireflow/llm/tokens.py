"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the byte-level BPE vocabularies of this kind.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("quireflow", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text))


def token_sizes(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """key, *keep, n_tokens, cluster: the size of each text and the hash that its copies share.

    Null texts have size 0. ``cluster`` hashes the text with white space collapsed. Other columns are ignored.
    """
    src = df.select(F.col(key).alias("key"), *keep, F.col(text).alias("text"), F.xxhash64(F.trim(F.regexp_replace(F.col(text), "\\s+", " "))).alias("cluster"))
    types = dict(src.dtypes)

    def make():
        enc = encoding(path)

        def kernel(keys, texts, clusters, *rest):
            for k, t, c, *r in zip(keys, texts, clusters, *rest):
                yield (k, *r, len(enc.encode_ordinary(t)) if t else 0, c)

        return kernel

    kept = "".join(f"{c} {types[c]}, " for c in keep)
    return arrow_rows(src, ["key", "text", "cluster", *keep], f"key {types['key']}, {kept}n_tokens int, cluster long", make)
