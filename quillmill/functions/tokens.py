"""Public byte-pair tokenizers, read from a rank file."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Rank file of a public tokenizer; a parameter wherever tokens are counted.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public pattern that splits text before the merges of that file. (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def sent(spark: SparkSession, ranks: str) -> str:
    """Sends a rank file, a path or an address that Spark can read on the driver, to the executors; returns its name there."""
    spark.sparkContext.addFile(ranks)
    return ranks.rstrip("/").rsplit("/", 1)[-1]


def received(name: str):
    """The tokenizer of a rank file that was sent."""
    return encoding(SparkFiles.get(name))
