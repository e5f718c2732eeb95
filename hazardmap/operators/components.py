"""Connected components of an edge table.

Each task first contracts the edges it holds to a forest of stars (union-find over numpy arrays); then
large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014)
join what is left.  Long thin chains do not cost their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) with the components of edges a-b."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    on = label != np.arange(len(names))
    return names[on], names[label[on]]


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round: each node links its neighbours (the larger ones, or the smaller ones and itself) to the least it knows.

    Large stars may hold a link twice, at most as many links as went in and one for each node; small ones hold each once.
    """
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    joined = joined if small else joined.where(F.col("v") > F.col("u"))
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a <> b")
    return out.distinct() if small else out


def _is_forest(edges: DataFrame) -> bool:
    """Does every node but the roots, which hang on themselves here, hang on one root?"""
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), "b"))
    return ends.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least <> most").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b, of one type): label is the least node of its component.

    Self-links, repeated edges and edges with a null end change nothing; an empty table gives none.  Every round is
    written to the shared folder, so no lineage grows and lost executors cost only their tasks.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for frame in frames:
            x, y = forest(frame["a"].to_numpy(), frame["b"].to_numpy())
            a.append(x)
            b.append(y)
            if sum(map(len, a)) > 2_000_000:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                if len(x) > 1_500_000:  # no longer shrinking: pass it on
                    yield pd.DataFrame({"a": x, "b": y})
                    x, y = x[:0], y[:0]
                a, b = [x], [y]
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pd.DataFrame({"a": x, "b": y})

    edges = edges.select("a", "b").where("a <> b")
    edges = keep(edges.mapInPandas(contract, f"a {kind}, b {kind}"), "edges")
    while not _is_forest(edges):
        edges = keep(_star(_star(edges, False), True), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
