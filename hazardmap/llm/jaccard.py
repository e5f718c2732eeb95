"""Exact join of near-duplicate documents by Jaccard similarity of word shingles, with a token-group matrix.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (words split at ASCII white space,
A-Z lower-cased; with fewer than 5 words the whole sequence is one shingle).  Two documents link when
100 * |intersection| >= 75 * |union|; links are followed to components.

1. Equal sets collapse to one class, named by its least doc_id.
2. Shingles are ordered from rare to common.  The common ones come from counts over all documents, kept
   for the 262,144 most frequent; any order is right, a good one only saves work.  Linked sets share a
   shingle among the first |x| - ceil(0.75 |x|) + 1 of each (their prefixes), so only classes that share a
   prefix shingle with another class go on.
3. These classes are sorted so that similar ones stand together and are numbered in groups of bounded size.
   The token-group matrix says which group holds which prefix shingle, and in members of which sizes.  With c
   prefix shingles of a class x in group g, no member y can share more than c + max(ceil(.75 |x|), ceil(.75 |y|)) - 1
   shingles with x; groups whose bound falls short for every size are left out.
4. Shingles that many groups hold come from crowds.  As long as they would make the next step wide, and wider than
   this one, their classes are first linked inside groups only, in another order each time, and followed to components.  From then on a
   shingle counts only if classes of two components hold it, so a crowd of near copies, which soon is one
   component, is not compared with itself over and over.
5. Only classes with a group left bring their whole sets.  Each group gathers its members' sets, their union
   and incidence; links inside it come from the incidence at once.  A class queries each remaining group of a lower
   number: its overlap with the group's union bounds that with every member, and only groups that can reach the
   threshold are opened.

No candidate is capped: every pair that can reach the threshold and is not yet known to be connected is tested
exactly.  Hot groups of copies collapse within tasks before any shuffle; hot shingles are spread by shingle and class in step 2, as they need not
meet; a group with many queries is tested in several tasks.  What stays
quadratic, in groups and not in documents, are crowds that share much of their prefixes without being linked.

Null and empty texts, and texts without words, have no shingles, link with nothing and are their own component.
Rows without a doc_id are compared like others; their component_id is null unless a link leads to a doc_id.
Rows that repeat a doc_id are compared each by its own text; those that share a name as their class's least doc_id
count as one document.
doc_ids are below 2^62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import text as tx
from .store import keep, release, small_batches

SHINGLE = 5
HOT = 1 << 18
NAMELESS = 1 << 62
#: Bytes that a shuffle takes, as measured: a shingle of a set, a prefix shingle placed and counted again, a class that meets a group by a shingle.
SET_BYTES, ROW_BYTES, PAIR_BYTES = 8, 48, 20
_K1, _K2, _K3 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row, and offsets by row."""
    s, e, row = tx.words(data, offs)
    h = tx.span_hash(data, s, e)
    n = len(offs) - 1
    grams, at = tx.word_ngrams(h, row, size)
    owner = row[at]
    count = np.bincount(row, minlength=n)
    for k in range(1, size):  # rows with fewer words than a shingle: all their words
        few = np.flatnonzero(count[row] == k) if k < size else []
        if len(few):
            g, i = tx.word_ngrams(h[few], row[few], k)
            grams, owner = np.concatenate([grams, g]), np.concatenate([owner, row[few][i]])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=n))])


def set_keys(grams: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two signed 64-bit numbers."""
    out = []
    for k in (_K1, _K2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(grams ^ k), dtype=np.uint64)])
        out.append(tx.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with a text column, each with its shingles and offsets."""
    for batch in batches:
        data, offs = tx.buffers(batch.column("text"))
        for lo, hi, part, at in tx.slices(data, offs):
            yield (batch.slice(lo, hi - lo), *shingle_sets(part, at))


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    """Of a set's n shingles in order, how many must hold one that a linked set's prefix holds too."""
    return np.where(n > 0, n - (3 * n + 3) // 4 + 1, 0)


def prefixes(grams: np.ndarray, offs: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles of all sets from rare to common, their rows, and their ranks (0: not among the hot)."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    r = np.zeros(len(grams), np.int64)
    if len(hot) and len(grams):
        i = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        r = np.where(hot[i] == grams, rank[i], 0)
    order = np.lexsort((grams, r, row))
    place = np.arange(len(grams)) - np.repeat(offs[:-1], np.diff(offs))
    take = order[place < np.repeat(prefix_lengths(np.diff(offs)), np.diff(offs))]
    return grams[take], row[take], r[take]


def _frame(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def named_rows(docs: DataFrame) -> DataFrame:
    """docs with __row (doc_id, or for rows without one a number from 2^62 on by text) and __text (a hash of the text)."""
    text = F.xxhash64("text")
    return docs.withColumns({"__row": F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(text, 2) + F.lit(NAMELESS)), "__text": text})


def document_sets(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """row, text (hash), n (shingles), k1 and k2 (the set's name), s1 and s2 (sort keys that bring similar sets together) of each document."""
    names = ("row", "text", "n", "k1", "k2", "s1", "s2")
    schema = pa.schema([(c, pa.int64()) for c in names])
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, grams, offs in _sets(batches):
            k1, k2 = set_keys(grams, offs)
            pre, row, rank = prefixes(grams, offs, *shared.value)
            some = np.diff(offs) > 0
            s1, s2 = np.zeros((2, part.num_rows), np.uint64)
            if some.any():
                s1[some] = grams[offs[:-1][some]]  # the least shingle
                s2[some] = np.minimum.reduceat(tx.mix(grams ^ _K3), offs[:-1][some])  # the least by another hash
            first = np.flatnonzero(rank > 0)[::-1]
            s1[row[first]] = pre[first]  # the first hot shingle of the prefix, if it has one
            yield _frame(schema, row=part.column("__row"), text=part.column("__text"), n=np.diff(offs), k1=k1, k2=k2, s1=s1.view(np.int64), s2=s2.view(np.int64))
        release()

    return docs.select("__row", "__text", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def hot_shingles(docs: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (ascending) and their ranks by frequency, from counts over all documents.

    A task counts every distinct set once and passes on the shingles it has seen three times or more.
    """
    schema = pa.schema([("gram", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            x = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            seen.clear()
            x.sort()
            third = np.flatnonzero(x[2:] == x[:-2])  # starts of runs of three equal ones
            gram = np.unique(x[third])
            c = np.searchsorted(x, gram, "right") - np.searchsorted(x, gram, "left")
            return _frame(schema, gram=gram.view(np.int64), c=c)

        for _, grams, offs in _sets(batches):
            k1, _ = set_keys(grams, offs)
            new = np.zeros(len(k1), bool)
            for i, k in enumerate(k1.tolist()):
                if k not in seen:
                    seen.add(k)
                    new[i] = True
            held.append(grams[np.repeat(new, np.diff(offs))])
            if sum(map(len, held)) > 2_000_000:
                yield flush()
        yield flush()
        release()

    counts = docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "gram").limit(most).toPandas()  # `most` rows at most
    gram = top["gram"].to_numpy(np.int64).view(np.uint64)
    rank = np.arange(len(gram), 0, -1)  # the most frequent last
    order = np.argsort(gram)
    return gram[order], rank[order]


def shared_prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, k1): prefix shingles that two or more different sets hold (hot ones: that may), with the sets' names.

    Shingles that are not hot meet in buckets by hash; a bucket's rows are packed, one row per task and bucket.
    """
    spark = docs.sparkSession
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts * 16  # a task meets one bucket at a time
    shared = spark.sparkContext.broadcast(hot)
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
    out = pa.schema([("gram", pa.int64()), ("k1", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            both = np.concatenate([np.zeros((0, 3), np.uint64), *held])
            held.clear()
            seen.clear()
            # below 0: hot shingles, which need no meeting and are spread with the sets' names
            bucket = (tx.mix(both[:, 0]) % np.uint64(buckets)).astype(np.int64)
            bucket = np.where(both[:, 2] > 0, -1 - (tx.mix(both[:, 0] ^ both[:, 1]) % np.uint64(buckets)).astype(np.int64), bucket)
            order = np.argsort(bucket, kind="stable")
            both, bucket = both[order, :2], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
            ends = np.append(cuts[1:], len(bucket))
            names, blobs = [], []
            for a, z in zip(cuts, ends):
                for lo in range(a, z, 1 << 14):
                    names.append(int(bucket[a]))
                    blobs.append(both[lo : min(z, lo + (1 << 14))].tobytes())
            if names:
                yield _frame(schema, bucket=names, blob=blobs)

        for _, grams, offs in _sets(batches):
            k1, _ = set_keys(grams, offs)
            new = np.diff(offs) > 0
            for i, k in enumerate(k1.tolist()):
                if k in seen:
                    new[i] = False
                seen.add(k)
            keep_rows = np.repeat(new, np.diff(offs))
            g, row, r = prefixes(grams[keep_rows], np.concatenate([[0], np.cumsum(np.diff(offs)[new])]), *shared.value)
            held.append(np.stack([g, k1[new].view(np.uint64)[row], r.astype(np.uint64)], 1))
            if sum(map(len, held)) > 500_000:
                yield from flush()
        yield from flush()
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = 0, []

        def close() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
            held.clear()
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[1:] != x[:-1]).any(1)
            x = x[fresh]
            if now >= 0:
                same = x[1:, 0] == x[:-1, 0]
                both = np.zeros(len(x), bool)
                both[1:] |= same
                both[:-1] |= same
                x = x[both]
            return _frame(out, gram=x.view(np.int64)[:, 0], k1=x.view(np.int64)[:, 1])

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if bucket != now and held:
                    yield close()
                now = bucket
                held.append(blob.as_py())
        yield close()
        release()

    packed = docs.select("text").mapInArrow(pack, "bucket int, blob binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "gram long, k1 long")


def linked(inter: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return 100 * inter >= 75 * (n + m - inter)


class Group:
    """Members' sets, their union and the incidence of both."""

    def __init__(self, reps: list[int], sets: list[np.ndarray]):
        """reps name the members; two members of one name are one document."""
        self.reps, self.sizes = np.array(reps, np.int64), np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.union, at = np.unique(flat, return_inverse=True)
        self.matrix = np.zeros((len(self.union), len(sets)), np.uint8)
        self.matrix[at, np.repeat(np.arange(len(sets)), self.sizes)] = 1
        self.comps = self.reps

    def join_inside(self) -> None:
        """Sets comps to the least member of each component of links inside the group."""
        m = len(self.reps)
        shared = np.flatnonzero(self.matrix.sum(1, dtype=np.int32) > 1)
        inter = np.zeros((m, m), np.float32)
        for lo in range(0, len(shared), 8192):
            part = self.matrix[shared[lo : lo + 8192]].astype(np.float32)
            inter += part.T @ part
        inter = inter.round().astype(np.int64)
        np.fill_diagonal(inter, self.sizes)
        link = 100 * inter >= 75 * (self.sizes[:, None] + self.sizes[None, :] - inter)
        label = self.reps.copy()
        while True:
            least = np.where(link, label[None, :], np.iinfo(np.int64).max).min(1)
            if (least == label).all():
                break
            label = least
        self.comps = label

    def query(self, grams: np.ndarray) -> list[int]:
        """Components of members that a set links with."""
        n = len(grams)
        possible = (4 * self.sizes >= 3 * n) & (3 * self.sizes <= 4 * n)
        if not possible.any():
            return []
        at = np.minimum(np.searchsorted(self.union, grams), len(self.union) - 1)
        at = at[self.union[at] == grams]
        if 175 * len(at) < 75 * (n + int(self.sizes[possible].min())):  # the bound: no member can overlap more than the union does
            return []
        inter = self.matrix[at].sum(0, dtype=np.int64)
        return np.unique(self.comps[possible & linked(inter, n, self.sizes)]).tolist()


def number_groups(active: DataFrame, order: list[Column], members: int = 256, shingles: int = 50_000) -> DataFrame:
    """active with gid: classes in the given order, cut into groups of bounded size."""
    parts = max(1, int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gid, count, size = TaskContext.get().partitionId() << 32, 0, 0
        for frame in frames:
            gids = []
            for n in frame["n"].tolist():
                if count and (count >= members or size + n > shingles):
                    gid, count, size = gid + 1, 0, 0
                gids.append(gid)
                count, size = count + 1, size + n
            yield frame.assign(gid=gids)

    dealt = active.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, ", ".join(f"{c} long" for c in [*active.columns, "gid"]))


def may_link(n: str = "n", c: str = "c", low: str = "lo", high: str = "hi") -> Column:
    """Can a class of n shingles link with a member of a group, between low and high shingles large, that holds c of its prefix?

    Up to n shingles the least overlap asked for does not fall with the member's size; beyond, it falls by 9/28 a
    shingle but for its two ceilings, so it is least at `low` or at one of the last four sizes.
    """
    low, high = f"greatest({low}, (3 * {n} + 3) div 4)", f"least({high}, (4 * {n}) div 3)"
    need = lambda m: f"(3 * ({n} + {m}) + 6) div 7 - greatest((3 * {n} + 3) div 4, (3 * {m} + 3) div 4) + 1"
    least = ", ".join([need(low), *(need(f"greatest({low}, {high} - {k})") for k in range(4))])
    return F.expr(f"{low} <= {high} and {c} >= least({least})")


def token_groups(placed: DataFrame) -> DataFrame:
    """The matrix: for each prefix shingle and group, its members (c), their sizes (lo, hi) and components (ca, cb)."""
    return placed.groupBy("gram", "gid").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("ca"), F.max("comp").alias("cb"))


def may_meet(placed: DataFrame, matrix: DataFrame) -> DataFrame:
    """rep, k1, n, gid and of: classes with the groups in which they may link with a class of another component.

    placed: gram and a numbered class (rep, k1, n, gid, comp).
    """
    fits = "g.gram = p.gram and not (g.ca = p.comp and g.cb = p.comp) and g.hi >= (3 * p.n + 3) div 4 and g.lo <= (4 * p.n) div 3 and (g.of <> p.gid or g.c > 1)"
    met = placed.alias("p").join(matrix.withColumnRenamed("gid", "of").alias("g"), F.expr(fits)).groupBy("p.rep", "p.k1", "p.gid", "p.n", "g.of").agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return keep(met.where(may_link()).select("rep", "k1", "n", "gid", "of"), "chosen")


def sent_shingles(chosen: DataFrame) -> int:
    """Shingles of all sets that the groups of may_meet() are sent: each class once as a member and once for each group that it queries."""
    return chosen.groupBy("rep", "k1").agg((F.max("n") * (1 + F.count_if(F.col("of") < F.col("gid")))).alias("x")).agg(F.sum("x")).first()[0] or 0


def targets_of(chosen: DataFrame, each: int = 256) -> DataFrame:
    """rep, k1 and to: where the sets of may_meet() go.

    A class is a member of its own group (kind 0) and queries the others of a lower number (kind 1); a group with many
    queries is tested `each` queries at a time.
    """
    asked = chosen.where("of < gid").select("rep", "k1", F.col("of").alias("gid"))
    salts = asked.groupBy("gid").agg(F.ceil(F.count("*") / each).cast("int").alias("salts"))
    asks = asked.join(salts, "gid").select("rep", "k1", F.lit(1).alias("kind"), "gid", F.pmod(F.xxhash64("rep", "k1"), F.col("salts")).cast("int").alias("salt"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    homes = chosen.select("rep", "k1", "gid").distinct().join(salts, "gid", "left").select("rep", "k1", F.lit(0).alias("kind"), "gid", copies.alias("salt"))
    return asks.unionByName(homes).groupBy("rep", "k1").agg(F.collect_list(F.struct("kind", "gid", "salt")).alias("to"))


def across_groups(placed: DataFrame, matrix: DataFrame, each: int = 256) -> DataFrame:
    """(rep, k1, to) of classes that may link with a class of another component in any group."""
    return targets_of(may_meet(placed, matrix), each)


def link_groups(docs: DataFrame, targets: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Links (a, b) between classes, inside groups and across: enough of them to connect whatever is linked.

    targets: rep, k1 and to (kind, gid, salt).  A class's set goes to its own group as a member and to others as a
    query.  Targets of at most `most_bytes` are broadcast to the documents; else both meet by a shuffle.
    """
    spark = docs.sparkSession
    targets = keep(targets, "targets")
    size = targets.agg(F.coalesce(F.sum(F.size("to") * 40 + 80), F.lit(0)).alias("b")).first()["b"]
    targets = F.broadcast(targets) if size <= most_bytes else targets
    schema = pa.schema([("gid", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), ("rep", pa.int64()), ("k1", pa.int64()), ("grams", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            frame = _frame(schema, **dict(zip(schema.names, map(list, zip(*rows)))))
            rows.clear()
            held = 0
            return frame

        for part, grams, offs in _sets(batches):
            k1, _ = set_keys(grams, offs)
            for i in np.flatnonzero(k1 == part.column("k1").to_numpy()).tolist():  # a doc_id may stand for several texts
                rep, name = part.column("rep")[i].as_py(), int(k1[i])
                if (rep, name) in sent:  # a row that stands many times in the table is sent once by a task
                    continue
                sent.add((rep, name))
                own = grams[offs[i] : offs[i + 1]].tobytes()
                for t in part.column("to")[i].as_py():
                    rows.append((t["gid"], t["salt"], t["kind"], rep, name, own))
                    held += len(own)
                    if held > 4 << 20:
                        yield flush()
        if rows:
            yield flush()
        release()

    texts = docs.select(F.col("__row").alias("rep"), "text")
    sent = texts.join(targets, "rep").select("rep", "k1", "to", "text").mapInArrow(send, "gid long, salt int, kind int, rep long, k1 long, grams binary")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, group = None, [], [], None
        found: list[tuple[int, int]] = []

        def close() -> None:
            nonlocal group
            if group is None and names:
                group = Group([r for r, _ in names], sets)
                names.clear()
                sets.clear()
                group.join_inside()
                found.extend((a, b) for a, b in zip(group.reps.tolist(), group.comps.tolist()) if a != b)

        def flush() -> pa.RecordBatch:
            frame = _frame(links, a=[a for a, _ in found], b=[b for _, b in found])
            found.clear()
            return frame

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("gid", "salt", "kind", "rep", "k1")))
            for (gid, salt, kind, rep, name), grams in zip(keys, batch.column("grams")):
                if now != (gid, salt):
                    close()
                    now, group = (gid, salt), None
                    names.clear()
                    sets.clear()
                own = np.frombuffer(grams.as_buffer(), np.uint64)
                if kind == 0:
                    if not names or names[-1] != (rep, name):  # a row that stands twice in the table counts once
                        names.append((rep, name))
                        sets.append(own.copy())
                    continue
                close()
                if group is not None:
                    found.extend((rep, other) for other in group.query(own))
            yield flush()
        close()
        yield flush()
        release()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(parts, "gid", "salt").sortWithinPartitions("gid", "salt", "kind", "rep", "k1").mapInArrow(run, "a long, b long")


def connect(docs: DataFrame, postings: DataFrame, classes: DataFrame, rounds: int = 6, wide: int = 8) -> DataFrame:
    """(node, label) of linked classes; classes: rep, k1, n, s1, s2.

    A shingle of more than `wide` groups is wide.  While the wide ones make up most of the last step, their classes
    are linked inside groups only, up to `rounds` times and as long as each time halves that step.  Such a round sends
    all sets of these classes and places the shingles again, so it is left out where the whole last step moves less.
    """
    numbered = keep(number_groups(classes, ["s1", "n", "rep", "k1"]).select("rep", "k1", "n", "gid"), "numbered")
    comps, links, labels, chosen, pairs = numbered.withColumn("comp", F.col("rep")), None, None, None, float("inf")
    for step in range(rounds + 1):
        placed = keep(postings.join(comps, "k1"), "placed")
        matrix = keep(token_groups(placed), "matrix")
        crowds = matrix.groupBy("gram").agg(F.count("*").alias("g"), F.sum("c").alias("h"), F.min("ca").alias("ca"), F.max("cb").alias("cb"))
        crowds = keep(crowds.where((F.col("g") > wide) & (F.col("ca") < F.col("cb"))).select("gram", "g", "h"), "crowds")
        before, pairs = pairs, crowds.agg(F.sum(F.col("g") * F.col("h")).alias("x")).first()["x"] or 0
        rows = placed.count()
        if step == rounds or pairs <= rows or pairs > before / 2:
            break
        crowd = keep(placed.join(crowds.select("gram"), "gram").select("rep", "k1").distinct().join(classes, ["rep", "k1"]), "crowd")
        cost = SET_BYTES * (crowd.agg(F.sum("n")).first()[0] or 0) + ROW_BYTES * rows
        if PAIR_BYTES * pairs <= cost:
            chosen = may_meet(placed, matrix)
            if SET_BYTES * sent_shingles(chosen) <= cost:
                break
            chosen = None
        mixed = crowd.withColumn("mixed", F.xxhash64("rep", "k1", F.lit(step)))
        home = number_groups(mixed, [("s1", "s2")[step % 2], "mixed"]).select("rep", "k1", F.array(F.struct(F.lit(0).alias("kind"), "gid", F.lit(0).alias("salt"))).alias("to"))
        found = keep(link_groups(docs, home), "links")
        links = found if links is None else links.unionByName(found)
        labels = keep(components(links), "labels")
        comps = numbered.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "k1", "n", "gid", F.coalesce("label", "rep").alias("comp"))
    found = keep(link_groups(docs, targets_of(may_meet(placed, matrix) if chosen is None else chosen)), "links")
    return components(found if labels is None else found.unionByName(labels.toDF("a", "b")))


def row_components(docs: DataFrame) -> DataFrame:
    """row, text, n and comp of each row of named_rows(): comp is the least row that links lead to."""
    small_batches(docs.sparkSession)
    hot = hot_shingles(docs)
    each = keep(document_sets(docs, hot), "sets")
    classes = each.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("rep"), *(F.min(c).alias(c) for c in ("n", "s1", "s2")))
    postings = keep(shared_prefixes(docs, hot), "postings")
    sharing = keep(classes.join(postings.select("k1").distinct(), "k1", "left_semi").drop("k2"), "classes")
    labels = connect(docs, postings, sharing)
    named = classes.select("k1", "k2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("label", "rep").alias("comp"))
    found = each.where("n > 0").join(named, ["k1", "k2"]).select("row", "text", "n", "comp")
    return found.unionByName(each.where("n = 0").select("row", "text", "n", F.col("row").alias("comp")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to) of each document.

    docs needs doc_id and text; other columns are left out.
    """
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    return row_components(named_rows(docs.select("doc_id", "text"))).select(named("row").alias("doc_id"), F.col("n").alias("n_shingles"), named("comp").alias("component_id"))


def one_of_each(docs: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """docs without near copies: of each component one row stays (that of the least doc_id; of rows that repeat it, one).

    The rows that go are broadcast if they take at most `most_bytes`, else they meet the documents by a shuffle.
    """
    rows = named_rows(docs)
    found = keep(row_components(rows).groupBy(F.col("row").alias("__row"), F.col("text").alias("__text")).agg(F.max("n").alias("n"), F.max("comp").alias("comp"), F.count("*").alias("times")), "rows")
    stays = F.col("comp") == F.col("__row")
    # rows of one doc_id with different texts in the doc_id's own component: the least text hash stays
    first = found.where((F.col("n") > 0) & stays).groupBy("__row").agg(F.min("__text").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    others = found.where((F.col("n") > 0) & stays).join(first, "__row").where("__text <> first")
    gone = keep(found.where((F.col("n") > 0) & ~stays).select("__row", "__text").unionByName(others.select("__row", "__text")), "gone")
    bounded = lambda df: F.broadcast(df) if df.count() * 40 <= most_bytes else df
    kept = rows.join(bounded(gone), ["__row", "__text"], "left_anti")
    again = keep(found.where((F.col("n") > 0) & stays & (F.col("times") > 1)).select("__row", "__text"), "again")
    if not again.isEmpty():
        again = bounded(again)
        kept = kept.join(again, ["__row", "__text"], "left_anti").unionByName(kept.join(again, ["__row", "__text"], "left_semi").dropDuplicates(["__row", "__text"]))
    return kept.select(docs.columns)
