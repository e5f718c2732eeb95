"""Line dedup, centroid clusters and hard negatives against plain versions of themselves."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from hazardmap.llm import line_runs, negatives, orchard

BLANKS = " \t\n\x0b\x0c\r"
LONG = "This line is long enough to count as one, to be sure of it"


def plain_lines(rows, least_chars=40, least_docs=5):
    """(n_lines, n_dropped, kept) by row of (doc_id, text)."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add((doc, text if doc is None else None))
    keeper = {k: max((d for d, _ in h if d is not None), default=None) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(5)
    pool = [f"{LONG} {i}" for i in range(12)] + ["short line", "", "   ", "é" * 39 + "É", "é" * 40, LONG.upper(), f"\t {LONG.upper()} \r", "x" * 39, " " * 50 + "x" * 40]
    rows = [(i * 3, "\n".join(rng.choices(pool, k=rng.randrange(0, 9)))) for i in range(60)]
    rows += [(900, LONG), (900, LONG), (900, f"{LONG}\nother"), (901, None), (902, ""), (903, "\n\n"), (None, f"{LONG} 3\nno id"), (None, f"{LONG} 3\nno id"), (None, f"{LONG} 3")]
    rows += [(None, f"only rows without an id hold this line, five of them\n{i}") for i in range(6)] + [(5000, "\n".join(f"{LONG} {i % 7} {i % 2}" for i in range(5000)))]
    return rows


@pytest.mark.parametrize("batches,fan", [(1, 4), (5, 2), (8, 3)])
def test_lines_equal_a_plain_version(spark, batches, fan):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], "doc_id long, text string, key string, n_lines int, pos int")
    found = line_runs.dedup_lines(docs.repartition(5), batches=batches, fan=fan)
    assert found.columns.count("n_lines") == 1 and {"key", "pos", "text"} <= set(found.columns)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found.collect()), key=repr) == plain_lines(rows)


def test_lines_of_an_empty_table(spark):
    assert line_runs.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_hold_each_key_once(spark):
    runs = line_runs.Runs(spark, fan=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(bytes([k]), n) for k in range(n, n + 4)], "key binary, keeper long"))
    got = {r["key"][0]: r["keeper"] for r in runs.all().collect()}
    assert runs.all().count() == 8 and got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3, 7: 4}
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # compacted like a binary number
    assert runs.unseen(spark.createDataFrame([(bytes([7]),), (bytes([8]),)], "key binary")).count() == 1


def plain_clusters(rows, k, rounds, dims, scale, seed=3):
    """{row number: (cluster, distance)}, final centroids; rows: (vec_id, components)."""
    ok = {n: [math.floor(scale * float(x)) for x in v] for n, (_, v) in enumerate(rows) if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)}
    order = sorted(ok, key=lambda n: ((rows[n][0] is None), hashlib.sha256(f"{seed}:{rows[n][0]}".encode()).hexdigest() if rows[n][0] is not None else "", ok[n]))
    centroids = [ok[n] for n in order[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        at = {n: assign(v)[1] for n, v in ok.items()}
        centroids = [[sum(c) // len(own) for c in zip(*own)] if (own := [ok[n] for n in ok if at[n] == i]) else centroids[i] for i in range(len(centroids))]
    return {n: assign(v)[::-1] for n, v in ok.items()}, centroids


def vectors(n, dims, seed=1, grid=4):
    """Vectors on a coarse grid, so that many distances tie, with odd rows among them."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-grid, grid + 1) / 4 for _ in range(dims)]) for i in range(n)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (n, None), (n + 1, []), (n + 2, [0.5] * (dims - 1)), (n + 3, [float("nan")] + [0.0] * (dims - 1)), (n + 4, [float("inf")] + [0.0] * (dims - 1)), (n + 5, [None] + [0.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize("n,k", [(150, 8), (3, 8), (40, 1)])
def test_clusters_equal_a_plain_version(spark, n, k):
    rows = vectors(n, 3)[(0 if n > 10 else n) :] if n > 10 else [r for r in vectors(10, 3) if r[0] in (0, 1, 2, 13, 14)]
    df = spark.createDataFrame([(i, v, "c", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, other int").repartition(4)
    found = orchard.cluster_vectors(df, k=k, dims=3, scale=4).collect()
    want, centroids = plain_clusters(rows, k, 10, 3, 4)
    key = lambda x: sorted(x, key=repr)
    assert key((r["vec_id"], tuple(r["embedding"]), r["cluster"], r["distance"], tuple(r["centroid"])) for r in found) == key((rows[n][0], tuple(rows[n][1]), c, d, tuple(centroids[c])) for n, (c, d) in want.items())
    sums = {}
    for c, d in want.values():
        sums[c] = sums.get(c, 0) + d
    assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) and r["other"] == 0 for r in found)


def test_clusters_of_an_empty_table(spark):
    found = orchard.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.count() == 0 and {"cluster", "distance", "inertia", "centroid"} <= set(found.columns)


def test_orchard_search_equals_all_distances():
    rng = np.random.default_rng(2)
    for k, grid in ((1, 3), (2, 1), (8, 2), (30, 4)):
        x, c = rng.integers(-grid, grid + 1, (400, 4)), rng.integers(-grid, grid + 1, (k, 4))
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        at, best = orchard.search(x, c)
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    big = np.full((2, 64), orchard.limit(64))
    at, best = orchard.search(big, np.array([-big[0], big[0]]))
    assert at.tolist() == [1, 1] and best.tolist() == [0, 0]


def test_scores_are_exact():
    rng = np.random.default_rng(3)
    for dims, most in ((1, 1), (64, 255), (64, 1 << 24), (200, 1 << 23), (3, 1 << 26), (64, 0)):
        a, b = rng.integers(-most, most + 1, (5, dims)), rng.integers(-most, most + 1, (7, dims))
        a[0], b[0] = most, -most
        of = negatives.primes(dims * most * most)
        got = negatives.product([negatives.residues(a, p) for p in of], [negatives.residues(b, p) for p in of], of)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert max(negatives.primes(1 << 60)) ** 2 // 4 * negatives.CHUNK < 1 << 24


def plain_negatives(rows, scale=256):
    """rows: (vec_id, label, components); the label already changed; as tuples of the result."""
    ok = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = min(ok.get(i, (math.inf,)), (label, [math.floor(scale * float(x)) for x in v]))
    out = []
    for a in ok:
        if a % 10:
            continue
        score = {i: sum(x * y for x, y in zip(ok[a][1], ok[i][1])) for i in ok if i != a}
        first = lambda ids, n: sorted(ids, key=lambda i: (-score[i], i))[:n]
        for p in first([i for i in score if ok[i][0] == ok[a][0]], 5):
            inside = [i for i in score if ok[i][0] != ok[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(first(inside, 5), 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_negatives_equal_a_plain_version(spark, block):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), v) for i, v in vectors(120, 6, seed=9, grid=2)]
    rows += [(200 + i, i % 3, [0.5] * 6) for i in range(40)] + [(300, None, [0.5] * 6), (310, 1, [-0.25] * 3), (320, 9, [1.0] * 6), (330, 2, [-1.0] * 6), (331, 2, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, score string, rank int").repartition(5)
    found = negatives.hard_negatives(df, 10, block=block)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    schema = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(100, 1, [1.0, 2.0])], [(1, 1, [1.0]), (2, 2, [1.0])], [(100, 1, None), (200, None, [1.0]), (None, 1, [1.0])], [(100, 1, []), (200, 1, []), (3, 2, [])]):
        df = spark.createDataFrame(rows, schema)
        got = [tuple(r) for r in negatives.hard_negatives(df).collect()]
        assert got == ([(100, 200, 1, 3, 0, 0), (200, 100, 1, 3, 0, 0)] if len(rows) == 3 and rows[0][2] == [] else [])


def test_padding_of_sliced_columns():
    column = pa.array([[9], [1, 2], [], [3]], pa.list_(pa.int32())).slice(1)
    assert negatives._padded(column, 2).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert orchard.matrix(pa.array([[9, 9], [1, 2]], pa.list_(pa.int32())).slice(1), 2).tolist() == [[1, 2]]
