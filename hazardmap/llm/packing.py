"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (its text's, then id 0) fill whole windows as far as they go; what is left is cut
into near-equal pieces of at most `grain` ids.  The pieces of a block go into windows by multiway
differencing: every piece starts as a partial partition with one filled slot, and the two partial
partitions with the largest imbalance are merged, fullest slots of one with emptiest of the other,
until one partition is left.  If its fullest window exceeds the capacity, the window count rises by
one and the block is packed again.  Blocks are formed within Spark's own partitions, so nothing is
shuffled and a lost task is simply run again.

Null texts count as empty (one id, 0).  Repeated rows are packed one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import default_path, encode
from .store import release, small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of indexes of `sizes` with near-equal sums, by multiway differencing."""
    n = len(sizes)
    sums = [np.concatenate([[x], np.zeros(k - 1, np.int64)]) for x in sizes]
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-x, i) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = (-both).argsort(kind="stable")
        both = both[order] - both[order[-1]]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(both[0]), n + len(made)))
        made.append((a, b, order))
        sums.append(both)
    slots = {heap[0][1]: np.arange(k)} if heap else {}
    window = [0] * n  # from the last merge back: which window each part's slots have become
    for i in range(n + len(made) - 1, n - 1, -1):
        a, b, order = made[i - n]
        at = np.empty(k, np.int64)
        at[order] = slots.pop(i)
        slots[a], slots[b] = at, at[::-1]
    for i, at in slots.items():
        window[i] = int(at[0])
    groups: list[list[int]] = [[] for _ in range(k)]
    for i, w in enumerate(window):
        groups[w].append(i)
    return groups


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of indexes whose sums fit the capacity: as few windows as differencing fills."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        groups = [g for g in difference(sizes, k) if g]
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return groups
        k += 1


def pieces(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole windows, then near-equal pieces of at most `grain`."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    if rest := n - full * capacity:
        parts = -(-rest // grain)
        at = [full * capacity + rest * i // parts for i in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(at, at[1:])]
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, grain: int = 256, block: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a byte-level vocabulary in the tokenizers library's JSON, readable on every worker.
    block: least number of pieces packed together (twice as many at most): a block closes when its ids fall
    short of a whole number of windows by 3 to 10 ids a window, so that differencing seldom needs another one;
    the last block of a partition holds what is left.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 36
        waiting: list[list[int]] = []
        held = 0
        rows: list[list[int]] = []

        def close() -> None:
            nonlocal serial, held
            for group in pack([w[2] for w in waiting], capacity):
                offset = 0
                for i in group:
                    rows.append([*waiting[i], serial, offset])
                    offset += waiting[i][2]
                serial += 1
            waiting.clear()
            held = 0

        def due() -> bool:
            short, windows = -held % capacity, -(-held // capacity)
            return len(waiting) >= 2 * block or len(waiting) >= block and 3 * windows <= short <= 10 * windows

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = (encode(text, path) if isinstance(text, str) else b"") + bytes(4)
                n = len(ids) // 4
                for start, length in pieces(n, capacity, grain):
                    row = [doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n]
                    if length == capacity:
                        rows.append([*row, serial, 0])
                        serial += 1
                    else:
                        waiting.append([doc_id, start, length, row[3], n])
                        held += length
                        if due():
                            close()
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=SCHEMA.replace(" long", "").split(", "))
                    rows.clear()
        close()
        yield pd.DataFrame(rows, columns=SCHEMA.replace(" long", "").split(", "), dtype="int64")
        release()

    none = -(1 << 63)  # stands for a null id inside the tasks
    packed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), "text").mapInPandas(run, SCHEMA)
    return packed.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
