"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of `least` words) are compared: the longest common
runs of words are found by Karp-Rabin hashing of windows and marked as tiles, longest first, never
overlapping in either text, until none of `least` words is left (running Karp-Rabin greedy string tiling,
with the window length falling from long to `least`).  The share of an item's words that its tiles cover is
its coverage; at `threshold` or more the document is contaminated.  Tiles need not stand in the item's
order, so reordered passages count.

Words are runs of letters, digits and non-ASCII characters, lower-cased.  Short items, of fewer than `least_words`
words, must stand in a document whole, as one run anywhere, and are reported as short.
Null and empty texts match nothing.  An item_id that repeats with several texts has the coverage of the best one;
items without an id count like others.  Repeated documents get repeated results.

A benchmark of up to `block_words` words is broadcast; a larger one goes over the documents block by block, one
broadcast at a time, and what the blocks found is joined to the documents by a hash of their text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import keep, release, small_batches

START = 32


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a column, and offsets by row."""
    data, offs = tx.buffers(pc.utf8_lower(column))
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(column), np.int64)
    for lo, hi, part, at in tx.slices(data, offs):
        s, e, row = tx.words(part, at, tx.PUNCT)
        out.append(tx.span_hash(part, s, e))
        counts[lo:hi] += np.bincount(row, minlength=hi - lo)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def _windows(words: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin value and start of each unmarked window."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, at = tx.word_ngrams(words, np.zeros(len(words), np.int8), size)
    seen = np.concatenate([[0], np.cumsum(marked)])
    free = seen[at + size] == seen[at]
    return value[free], at[free]


def _runs(own: np.ndarray, where: np.ndarray, value: np.ndarray, at: np.ndarray, size: int, item: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of equal windows: (item start, doc start, length) of those of the greatest length.

    own, where: sorted values and starts of the document's windows; value, at: those of the item's.  The document is
    looked at in stretches of so many windows that about `most` pairs are held at once; a stretch sees `item` words
    more than its own starts, as no run is longer.
    """
    lo, hi = np.searchsorted(own, value, "left"), np.searchsorted(own, value, "right")
    none = np.zeros(0, np.int64)
    best = (none, none, 0)
    if not (hi > lo).any():
        return none, none, none
    pairs, span = int((hi - lo).sum()), int(where.max()) + 1
    width = span if pairs <= most else max(1, span * most // pairs)
    for begin in range(0, span, width):
        end = begin + width
        near = (where >= begin - 1) & (where < end + item)
        o, w = own[near], where[near]
        a, n = np.searchsorted(o, value, "left"), np.searchsorted(o, value, "right") - np.searchsorted(o, value, "left")
        i = np.repeat(at, n)
        j = w[np.repeat(a, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((i, j - i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)])) if len(i) else none
        length = np.diff(np.append(first, len(i))) + size - 1
        i, j = i[first], j[first]
        mine = (j >= begin) & (j < end)
        i, j, length = i[mine], j[mine], length[mine]
        if len(length) and length.max() >= best[2]:
            top = length == length.max()
            more = (i[top], j[top], int(length.max()))
            best = more if more[2] > best[2] else (np.concatenate([best[0], more[0]]), np.concatenate([best[1], more[1]]), best[2])
    return best[0], best[1], np.full(len(best[0]), best[2])


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles of two word sequences."""
    mi, md = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(START, len(item), len(doc)))
    while True:
        own, where = _windows(doc, md, size)
        order = np.argsort(own, kind="stable")
        runs = _runs(own[order], where[order], *_windows(item, mi, size), size, len(item))
        if not len(runs[0]):
            if size <= least:
                return out
            size = max(least, size // 2)
            continue
        longest = int(runs[2][0])
        if longest > 2 * size:
            size = longest
            continue
        for i, j in sorted(zip(runs[0].tolist(), runs[1].tolist())):
            if not mi[i : i + longest].any() and not md[j : j + longest].any():
                mi[i : i + longest] = md[j : j + longest] = True
                out.append((i, j, longest))


def _holds(words: np.ndarray, run: np.ndarray) -> bool:
    """Does a word sequence hold another as one run?"""
    at = np.flatnonzero(words[: len(words) - len(run) + 1] == run[0]) if len(words) >= len(run) else np.zeros(0, np.int64)
    for k in range(1, len(run)):
        at = at[words[at + k] == run[k]]
    return len(at) > 0


class Index:
    """Seeds of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str], least: int, least_words: int):
        words, offs = word_hashes(pa.array(texts, pa.large_string()))
        self.least, self.least_words = least, least_words
        every = [(i, words[a:b]) for i, a, b in zip(ids, offs, offs[1:])]
        self.items = [(i, w) for i, w in every if len(w) >= least]
        self.tiny: dict[int, dict[int, list[int | None]]] = {}  # items of fewer words than a seed, by their number of words and the hash of all
        for i, w in every:
            if 0 < len(w) < least:
                whole = int(tx.word_ngrams(w, np.zeros(len(w), np.int8), len(w))[0][0])
                self.tiny.setdefault(len(w), {}).setdefault(whole, []).append(i)
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        grams = [tx.word_ngrams(w, np.zeros(len(w), np.int8), least)[0] for _, w in self.items]
        seed = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.lexsort((owner, seed))
        self.seed, self.owner = seed[order], owner[order]
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def shared(self, grams: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places of shared seeds) of one text for each item whose shared seeds could cover `threshold` of it."""
        maybe = np.flatnonzero(self.known[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        distinct, back = np.unique(grams[maybe], return_inverse=True)
        lo, hi = np.searchsorted(self.seed, distinct, "left"), np.searchsorted(self.seed, distinct, "right")
        owners = self.owner[np.repeat(lo, hi - lo) + np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        each, count = np.unique(owners, return_counts=True)  # a seed counts for each of its places in the item
        each = each[count * self.least >= threshold * self.sizes[each]]
        if not len(each):
            return
        for o in each.tolist():
            own = np.zeros(len(distinct), bool)
            own[np.repeat(np.arange(len(distinct)), hi - lo)[owners == o]] = True
            yield o, at[maybe[own[back]]]

    def compare(self, column: pa.Array, threshold: float) -> list[list[tuple[int | None, float, bool]]]:
        """(item, coverage, short) of items at or over the threshold, for each text; a short one stands whole somewhere in it."""
        found: list[list[tuple[int | None, float, bool]]] = [[] for _ in range(len(column))]
        words, offs = word_hashes(column)
        row = np.repeat(np.arange(len(column)), np.diff(offs))
        grams, at = tx.word_ngrams(words, row, self.least)
        cuts = np.searchsorted(row[at], np.arange(len(column) + 1))
        hit = np.zeros(len(column), bool)
        hit[row[at[self.known[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)]]]] = True
        for r in np.flatnonzero(hit).tolist():
            text = words[offs[r] : offs[r + 1]]
            for o, places in self.shared(grams[cuts[r] : cuts[r + 1]], at[cuts[r] : cuts[r + 1]] - offs[r], threshold):
                item_id, item = self.items[o]
                if len(item) < self.least_words:
                    if _holds(text, item):
                        found[r].append((item_id, 1.0, True))
                    continue
                # words that any tile can cover: those of shared seeds
                near = np.unique(np.add.outer(places, np.arange(self.least)))
                if np.isin(item, text[near]).mean() < threshold:
                    continue
                # tiles lie in runs of seeds; a mark between runs keeps them apart
                cut = np.flatnonzero(np.diff(near) > 1) + 1
                doc = np.insert(text[near], cut, np.uint64(0))
                covered = sum(n for _, _, n in tiles(item, doc, self.least)) / len(item)
                if covered >= threshold:
                    found[r].append((item_id, covered, False))
        for n, items in self.tiny.items():
            grams, at = tx.word_ngrams(words, row, n)
            on = np.flatnonzero(np.isin(grams, np.array([*items], np.uint64)))
            for gram, r in {*zip(grams[on].tolist(), row[at[on]].tolist())}:
                found[r] += [(i, 1.0, True) for i in items[gram]]
        return [_best(x) for x in found]


def _best(found: list[tuple[int | None, float, bool]]) -> list[tuple[int | None, float, bool]]:
    """The highest coverage of each item, by id, and whether only short texts of it were found; those without an id last."""
    out: dict[int | None, tuple[float, bool]] = {}
    for i, c, short in found:
        c0, s0 = out.get(i, (0.0, True))
        out[i] = (max(c, c0), short and s0)
    return sorted(((i, *x) for i, x in out.items()), key=lambda x: (x[0] is None, x[0] or 0))


_indexes: dict[str, Index] = {}


def _index_for(key: str, shared, least: int, least_words: int) -> Index:
    """The index of a broadcast block, built once per worker; only the last one is held."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(*shared.value, least, least_words)
    return _indexes[key]


FOUND = "array<struct<item_id:long,coverage:double,short:boolean>>"


def _comparison(key: str, shared, least: int, least_words: int, threshold: float):
    """Column function from texts to the items of a broadcast block that they hold."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index_for(key, shared, least, least_words)
        for batch in batches:
            found = index.compare(pa.array(batch, pa.large_string(), from_pandas=True), threshold)
            yield pd.Series([[{"item_id": i, "coverage": c, "short": s} for i, c, s in x] for x in found])
        release()

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = 4, threshold: float = 0.6, least_words: int = 8, block_words: int = 2_000_000) -> DataFrame:
    """docs with items (array of item_id, coverage and short, by item_id), coverage (the highest, 0 if none) and contaminated.

    benchmark needs item_id (integer) and text.  Columns of these names in docs are replaced.
    """
    small_batches(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_words))

    def compared(k: int, texts: Column) -> tuple[Column, Broadcast]:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # about block_words words
        shared = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        return _comparison(uuid.uuid4().hex, shared, least, least_words, threshold)(texts), shared

    if blocks == 1:
        out = docs.withColumn("items", compared(0, F.col(text))[0])
    else:
        name = (F.xxhash64(text).alias("__h1"), F.hash(text).alias("__h2"))
        parts = []
        for k in range(blocks):
            found, shared = compared(k, F.col("__t"))
            parts.append(keep(docs.select(*name, F.col(text).alias("__t")).withColumn("__items", found).drop("__t").where(F.size("__items") > 0).distinct(), f"block{k}"))
            shared.destroy()
        every = reduce(DataFrame.unionByName, parts).groupBy("__h1", "__h2").agg(F.flatten(F.collect_list("__items")).alias("__items"))
        of = lambda i: F.filter("__items", lambda x: x["item_id"].eqNullSafe(i))
        best = F.transform(F.array_distinct(F.transform("__items", lambda x: x["item_id"])), lambda i: F.struct(i.alias("item_id"), F.array_max(F.transform(of(i), lambda x: x["coverage"])).alias("coverage"), F.forall(of(i), lambda x: x["short"]).alias("short")))
        every = every.withColumn("__items", F.array_sort(best, lambda a, b: F.when(a["item_id"].isNull(), 1).when(b["item_id"].isNull(), -1).when(a["item_id"] < b["item_id"], -1).otherwise(1)))
        out = docs.withColumns({"__h1": name[0], "__h2": name[1]}).join(every, ["__h1", "__h2"], "left").withColumn("items", F.coalesce("__items", F.array().cast(FOUND))).drop("__h1", "__h2", "__items")
    best = F.coalesce(F.array_max(F.transform("items", lambda x: x["coverage"])), F.lit(0.0))
    return out.withColumn("coverage", best).withColumn("contaminated", F.size("items") > 0)
