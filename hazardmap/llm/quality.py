"""Quality rules by document and by host.

Base rules need only the text: a document fails with fewer than 20 words, or with over 30 % of its words
in 8-word windows that stand twice or more in it.  Host rules look at whole domains: each document's rule
failures are counted by host (the `source` column), each host's rate for a rule is shrunk towards the
corpus by a beta prior fitted to all hosts' rates (method of moments), and the verdicts are joined back:

* a host whose shrunk rate of base failures reaches `block_rate` is blocked: none of its documents stays;
* a host whose shrunk rate for a soft rule reaches `strict_rate` is strict for that rule: its documents
  that fail the rule go;
* elsewhere a document goes only for failing a soft rule at twice its limit.

Soft rules: symbols (over 1 in 10 words), repeated lines (over 3 in 10 lines with a word), long or short
words (mean outside 2 to 15 characters), shouting (over 6 in 10 ASCII letters capital).

Null and empty texts have no words and fail.  A null host is a host of its own.  Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep, release, small_batches

#: The first five are columns of the result, the others serve the soft rules only.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
WINDOW = 8


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows found twice or more, by ranks of windows of 1, 2, 4 and 8 words."""
    n = len(words) - WINDOW + 1
    if n <= 1:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    rank, width = ids, 1
    while width < WINDOW:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        width *= 2
        if width < WINDOW:
            rank = np.unique(pair, return_inverse=True)[1]
    order = np.argsort(pair, kind="stable")
    equal = pair[order][1:] == pair[order][:-1]
    twice = np.zeros(n + 1, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()  # by space, \t \n \v \f \r
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    data = np.frombuffer(text.encode(), np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    letters = upper + int(((data >= 97) & (data <= 122)).sum())
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        letters,
    )


def _soft(scale: int) -> dict[str, Column]:
    """Soft rules at `scale` times their limits, over the struct __counts."""
    c = lambda n: F.col(f"__counts.{n}")
    return {
        "symbols": c("n_symbols") * 10 > c("n_words") * scale,
        "dup_lines": c("n_dup_lines") * 10 > c("n_lines") * 3 * scale,
        "word_length": (c("word_chars") > c("n_words") * 15 * scale) | (c("word_chars") * scale < c("n_words") * 2),
        "shouting": c("n_upper") * 10 > c("n_letters") * (6 if scale == 1 else 9),
    }


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __counts (a struct of COUNTS) and base_failed."""

    @F.pandas_udf("struct<" + ",".join(f"{n}:long" for n in COUNTS) + ">")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([measure(t) for t in batch], columns=list(COUNTS), dtype="int64")
        release()

    c = lambda n: F.col(f"__counts.{n}")
    return docs.withColumn("__counts", run(F.col(text))).withColumn("base_failed", (c("n_words") < 20) | (c("n_repeat_words") * 100 > c("n_words") * 30))


def host_verdicts(ruled: DataFrame, host: str = "source", block_rate: float = 0.8, strict_rate: float = 0.25) -> DataFrame:
    """One row per host: its documents, shrunk rates by rule, blocked, and strict flags by soft rule.

    The prior of a rule is the beta whose mean and variance are those of all hosts' rates; with no
    spread (one host, or equal rates) it weighs as much as 100 documents.
    """
    rules = {"base": F.col("base_failed"), **_soft(1)}
    by_host = ruled.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.sum(r.cast("long")).alias(f"f_{k}") for k, r in rules.items()))
    prior = by_host.agg(
        *(x for k in rules for x in ((F.sum(f"f_{k}") / F.sum("n")).alias(f"m_{k}"), F.coalesce(F.var_samp(F.col(f"f_{k}") / F.col("n")), F.lit(0.0)).alias(f"v_{k}")))
    )
    out = by_host.crossJoin(F.broadcast(prior))  # one row
    for k in rules:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        weight = F.when((v > 0) & (m > 0) & (m < 1), F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), m * (1 - m) / v - 1))).otherwise(100.0)
        out = out.withColumn(f"rate_{k}", (F.col(f"f_{k}") + m * weight) / (F.col("n") + weight))
    return out.select(
        "host", "n", *(f"rate_{k}" for k in rules), (F.col("rate_base") >= block_rate).alias("blocked"), *((F.col(f"rate_{k}") >= strict_rate).alias(f"strict_{k}") for k in rules if k != "base")
    )


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", block_rate: float = 0.8, strict_rate: float = 0.25, with_text: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_blocked and kept; columns of these names are replaced.

    Texts are read once: rows with their counts are written to the shared folder, without the text if with_text is False.
    The hosts' table is small beside the documents; Spark broadcasts it while it is under
    spark.sql.autoBroadcastJoinThreshold and otherwise joins by host, splitting skewed hosts.
    """
    small_batches(docs.sparkSession)
    ruled = document_rules(docs, text)
    ruled = keep(ruled if with_text else ruled.drop(text), "ruled")
    verdicts = host_verdicts(ruled, host, block_rate, strict_rate)
    soft, hard = _soft(1), _soft(2)
    joined = ruled.join(verdicts.select(F.col("host").alias("__host"), F.col("blocked").alias("__blocked"), *(F.col(f"strict_{k}").alias(f"__strict_{k}") for k in soft)), F.col(host).eqNullSafe(F.col("__host")))
    fails = F.lit(False)
    for k in soft:
        fails = fails | (soft[k] & F.col(f"__strict_{k}")) | hard[k]
    kept = ~F.col("base_failed") & ~F.col("__blocked") & ~fails
    out = joined.withColumns({"kept": kept, "host_blocked": F.col("__blocked"), **{n: F.col(f"__counts.{n}") for n in COUNTS[:5]}})
    return out.drop("__host", "__blocked", "__counts", *(f"__strict_{k}" for k in soft))
