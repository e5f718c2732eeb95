"""Hard negatives by exact inner products in a residue number system.

Components are integers.  For several primes under 1,024 both matrices are reduced to residues of at most half a
prime, multiplied in float32 over 64 components at a time (every partial sum stays under 2**24, so nothing is rounded) and
reduced again.  Mixed-radix digits (Garner's form of Chinese remaindering) with signs give the exact signed scores
back.  As many primes are taken as twice the largest possible score needs, which follows from the largest component.

Anchors go over all rows in blocks of a bounded number.  A first pass keeps for each anchor the best rows of its
label, a second one those rows of other labels whose score lies in the window of each positive.  Tasks keep a few
rows an anchor while they read, and Spark merges what the tasks found.

Defined cases: rows without id or label, without a vector, or with a null or non-finite component take no part; shorter
vectors are as if filled with zeros; of rows that repeat an id the one of the least label, then vector counts; ties go to
the smaller id; an empty table, or one without anchors, positives or rows in a window, gives no rows; other columns are
ignored.  Components beyond limit(dims), 33 million for 64 of them, count as that limit, so that scores stay exact in 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .orchard import finite, floored
from .store import keep, release

CHUNK = 64  # components multiplied before residues are taken again
ROWS, ANCHORS = 4096, 512  # of one product
BLOCK = 4096  # anchors of one pass over the rows: 1 MB of 64 components
NONE = np.iinfo(np.int64).min


def limit(dims: int) -> int:
    """Components of this size still have scores, a hundred times over, under 2**63."""
    return 1 << int((56 - math.ceil(math.log2(max(dims, 1)))) // 2)


def primes(bound: int) -> list[int]:
    """Primes under 1,024, largest first, whose product exceeds 2 * bound; half of each, squared, times CHUNK is under 2**24."""
    found, product = [], 1
    for p in range(1023, 2, -2):
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
            if product > 2 * bound:
                return found
    raise ValueError("scores are too large")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p between -p/2 and p/2, in float32."""
    return ((x + p // 2) % p - p // 2).astype(np.float32)


def product(left: list[np.ndarray], right: list[np.ndarray], of: list[int]) -> np.ndarray:
    """Exact left @ right.T from their residues: one matrix a prime."""
    digits: list[np.ndarray] = []
    for n, p in enumerate(of):
        r = np.zeros((len(left[n]), len(right[n])), np.int64)
        for k in range(0, left[n].shape[1], CHUNK):
            r += (left[n][:, k : k + CHUNK] @ right[n][:, k : k + CHUNK].T).astype(np.int64)
        base = 1
        for d, q in zip(digits, of):  # less what the digits so far stand for
            r -= d * (base % p)
            base *= q
        r %= p
        r *= pow(base, -1, p)
        r += p // 2
        r %= p
        r -= p // 2
        digits.append(r)
    total, base = np.zeros_like(digits[0]), 1
    for d, q in zip(digits, of):
        total += d * np.int64((base + (1 << 63)) % (1 << 64) - (1 << 63))
        base *= q
    return total


def first(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the n highest allowed scores and their ids; ids ascend, so the smallest of tied ones comes first."""
    left, row = np.where(allowed, scores, NONE), np.arange(len(scores))
    out, who = np.full((len(scores), n), NONE), np.zeros((len(scores), n), np.int64)
    for k in range(n):
        j = left.argmax(1)
        out[:, k] = left[row, j]
        if (out[:, k] == NONE).all():
            break
        who[:, k] = ids[j]
        left[row, j] = NONE
    return out, who


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n of two lists a row, by score, then id."""
    s, w = np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]])
    order = np.lexsort((w, ~s), axis=1)[:, :n]  # ~s reverses the order of s without overflow
    return np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix of dims columns, shorter rows filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    out = np.zeros((len(column), dims), np.int64)
    size = np.diff(ends)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(ends[:-1], size)] = flat
    return out


class Anchors:
    """A block of anchors; positives: the scores of each one's positives (NONE where it has fewer), once they are known."""

    def __init__(self, ids: list[int], labels: list[int], vectors: np.ndarray, bound: int) -> None:
        self.ids, self.labels, self.vectors, self.primes = np.array(ids, np.int64), np.array(labels, np.int64), vectors, primes(bound)
        self.positives = np.zeros((len(ids), 0), np.int64)

    def scores(self, table: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For pieces of a batch: first anchor, scores, ids and labels, by ascending id."""
        ids = table.column("vec_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        ids, labels = ids[order], table.column("label").to_numpy(zero_copy_only=False)[order]
        x = _padded(table.column("v"), self.vectors.shape[1])[order]
        own = [residues(self.vectors, p) for p in self.primes]
        for r in range(0, len(ids), ROWS):
            right = [residues(x[r : r + ROWS], p) for p in self.primes]
            for a in range(0, len(self.ids), ANCHORS):
                yield a, product([o[a : a + ANCHORS] for o in own], right, self.primes), ids[r : r + ROWS], labels[r : r + ROWS]

    def best(self, batches: Iterator[pa.RecordBatch], n: int, allowed: Callable, lists: int) -> Iterator[pa.RecordBatch]:
        """The first n rows of every list of each anchor.  allowed(anchors, list, scores, ids, labels): which rows may stand in it."""
        s, w = np.full((lists, len(self.ids), n), NONE), np.zeros((lists, len(self.ids), n), np.int64)
        for batch in batches:
            for a, scores, ids, labels in self.scores(batch):
                at = slice(a, a + len(scores))
                for k in range(lists):
                    s[k, at], w[k, at] = merged((s[k, at], w[k, at]), first(scores, allowed(at, k, scores, ids, labels), ids, n), n)
        k, a, i = np.nonzero(s != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(k.astype(np.int32)), pa.array(w[k, a, i]), pa.array(s[k, a, i])], ["anchor_id", "list", "id", "score"])
        release()


FOUND = "anchor_id long, list int, id long, score long"


def _first_of_all(found: DataFrame, n: int) -> DataFrame:
    """What the tasks found, as the first n rows of each list with their rank from 1."""
    rank = F.row_number().over(W.partitionBy("anchor_id", "list").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def _one_of_each_id(rows: DataFrame) -> DataFrame:
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return keep(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*"), "vectors")


def hard_negatives(
    rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, vec: str = "embedding", vec_id: str = "vec_id", label: str | Column = "label", block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id `every` divides.  Positives are the first n_positives other rows of an anchor's label; for each, the
    first n_negatives rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark, is_anchor = rows.sparkSession, F.col("vec_id") % every == 0
    label = F.col(label) if isinstance(label, str) else label
    usable = F.col(vec_id).isNotNull() & label.isNotNull() & finite(vec)
    dims = rows.where(usable).agg(F.max(F.size(vec))).first()[0] or 1
    got = rows.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), floored(vec, scale, limit(dims)).alias("v"))
    got = _one_of_each_id(keep(got, "vectors"))
    most, anchors = got.agg(F.max(F.array_max(F.transform("v", F.abs))), F.count_if(is_anchor)).first()
    bound = dims * int(most or 0) ** 2
    blocks = max(1, math.ceil(anchors / block))
    out = []
    for number in range(blocks):
        asked = got.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number)).toArrow()  # about `block` rows
        if not len(asked):
            continue
        one = Anchors(asked["vec_id"].to_pylist(), asked["label"].to_pylist(), _padded(asked["v"], dims), bound)

        def same(batches: Iterator[pa.RecordBatch], one: Anchors = one) -> Iterator[pa.RecordBatch]:
            return one.best(batches, n_positives, lambda at, k, s, ids, labels: (one.labels[at, None] == labels) & (one.ids[at, None] != ids), 1)

        positives = _first_of_all(got.mapInArrow(same, FOUND), n_positives).select("anchor_id", F.col("rank").alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        positives = keep(positives, "positives")
        told = positives.toArrow()  # about n_positives * block rows
        one.positives = np.full((len(one.ids), n_positives), NONE)
        place = {a: i for i, a in enumerate(one.ids.tolist())}
        for a, k, s in zip(told["anchor_id"].to_pylist(), told["list"].to_pylist(), told["positive_score"].to_pylist()):
            one.positives[place[a], k - 1] = s

        def window(batches: Iterator[pa.RecordBatch], one: Anchors = one) -> Iterator[pa.RecordBatch]:
            def allowed(at: slice, k: int, s: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
                p = one.positives[at, k, None]
                known = np.where(p == NONE, 0, p)
                return (p != NONE) & (one.labels[at, None] != labels) & (100 * s >= low * known) & (100 * s <= high * known)

            return one.best(batches, n_negatives, allowed, n_positives)

        negatives = _first_of_all(got.mapInArrow(window, FOUND), n_negatives).withColumn("list", F.col("list") + 1)
        met = negatives.join(positives, ["anchor_id", "list"])
        out.append(keep(met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)
