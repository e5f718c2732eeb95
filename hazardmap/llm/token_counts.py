"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as its bytes in a linked list; the adjacent pair of lowest rank (leftmost among
equals) is popped from a heap and merged until no pair has a rank.  Its count is the number of
bytes less the number of merges; no ids are made.  Counts of words are remembered per worker.

Null texts count as empty (0 bytes, 0 tokens).  Repeated rows give repeated results.  Added tokens
(such as the end string) inside a text are one token each, as the library's default has it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import default_path, merges, pretokens, special
from .store import release, small_batches


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], tuple[int, str]]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(found[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, ""
        merged += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if found := ranks.get((symbols[i], symbols[k])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (found := ranks.get((symbols[h], symbols[i]))):
            heapq.heappush(heap, (found[0], h, symbols[h], symbols[i]))
    return n - merged


class Counts(dict):
    """pre-token -> tokens; emptied when it holds `most`, and long pre-tokens are not kept."""

    def __init__(self, path: str, most: int = 600_000):
        self.ranks, self.letters = merges(path)
        self.most = most

    def __missing__(self, token: str) -> int:
        n = merged_length([self.letters[b] for b in token.encode()], self.ranks)
        if len(token) < 64:
            if len(self) >= self.most:
                self.clear()
            self[token] = n
        return n


@lru_cache(2)
def _counts(path: str) -> Counts:
    return Counts(path)


def count_tokens(text: str, path: str) -> int:
    look = _counts(path).__getitem__
    added = special(path)
    parts = added.split(text) if added else [text]
    return len(parts) - 1 + sum(sum(map(look, pretokens(part))) for part in parts)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit); columns of these names are replaced.

    path: a byte-level vocabulary in the tokenizers library's JSON, readable on every worker.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([0 if t is None else count_tokens(t, path) for t in batch], dtype="int64")
        release()

    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", tokens(F.col(text)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
