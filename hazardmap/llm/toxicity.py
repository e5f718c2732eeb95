"""Toxicity by a small convolutional network over hashed word embeddings.

Words (runs of letters, digits and non-ASCII bytes, lower case) are hashed to rows of an embedding table; a
word's vector is the sum of its own row and that of its first bytes, so unseen forms of a known stem count;
filters of width 1, 2 and 3 slide over them, each filter's maximum over the text goes through a ReLU into
a logistic unit.  Everything is trained in numpy (Adam, dropout of words and pooled features) on a bounded sample
of labelled rows, rare classes balanced by weights.

Thresholds are calibrated by language on all labelled rows that are not in the sample: Spark scores their whole
texts and counts them by language, label and fine score bin.  A label's counts are scaled to its rows in the
whole labelled table, as the sample takes another share of each label.  For each language the raw threshold with the best F1
is found, and raw scores are moved on the logit scale so that this threshold becomes `threshold` (0.3).  A text's language is guessed from its words by naive Bayes learned from the
sampled rows, so a row's own language column is never read when scoring.

Null, empty and wordless texts get the score of a text whose filters all stay at zero.  With no labelled
rows, or only one class, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .samples import by_label
from .store import keep, release, small_batches

WIDTHS = (1, 2, 3)


@dataclass
class Model:
    """taps: for each filter width, one table of responses (bucket x filter) per position; langs: log odds of words by language."""

    buckets: int
    taps: list[list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    lang_words: np.ndarray
    shift: np.ndarray


STEM_BYTES = 5


def word_ids(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word of a column and of its stem (two columns), and offsets by row; bucket 0 is left for padding."""
    data, offs = tx.buffers(column)
    ids, counts = [np.zeros((0, 2), np.int32)], np.zeros(len(column), np.int64)
    for lo, _, part, at in tx.slices(data, offs):
        s, e, row = tx.words(part, at, tx.PUNCT)
        both = np.stack([tx.span_hash(part, s, e), ~tx.span_hash(part, s, np.minimum(e, s + STEM_BYTES))], 1)
        ids.append((both % np.uint64(buckets - 1)).astype(np.int32) + 1)
        counts[lo : lo + len(at) - 1] += np.bincount(row, minlength=len(at) - 1)
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])


def _pooled(model: Model, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Maximum response of every filter over each text; texts with no word get zeros before the ReLU."""
    f = model.taps[0][0].shape[1]
    rows = len(offs) - 1
    out = np.zeros((rows, f * len(WIDTHS)), np.float32)
    size = np.diff(offs)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    wide = max(WIDTHS) - 1
    # every text followed by `wide` paddings, so windows never reach into the next text
    padded = np.zeros((len(ids) + wide * len(some), 2), np.int32)
    shift = np.repeat(np.arange(len(some)) * wide, size[some])
    padded[np.arange(len(ids)) + shift] = ids
    first = np.concatenate([[0], np.cumsum(size[some] + wide)[:-1]])
    n = len(padded) - wide
    for k, w in enumerate(WIDTHS):
        response = np.zeros((n, f), np.float32)
        for j in range(w):
            for part in (0, 1):
                response += model.taps[k][j][padded[j : n + j, part]]
        # the paddings' own positions must not win: they are the last `wide` of each text but for the last one
        response[(first[1:, None] - 1 - np.arange(wide)).ravel()] = -1e9
        out[some, k * f : (k + 1) * f] = np.maximum.reduceat(response, first, axis=0)
    return out


def raw_scores(model: Model, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Logit of each text, before calibration."""
    return np.maximum(_pooled(model, ids, offs) + model.bias, 0) @ model.out + model.out_bias


def guess_language(model: Model, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the likeliest language of each text."""
    if model.lang_words.shape[1] == 0 or len(ids) == 0:
        return np.zeros(len(offs) - 1, np.int64)
    total = np.zeros((len(ids) + 1, model.lang_words.shape[1]))
    np.cumsum(model.lang_words[ids[:, 0]], axis=0, out=total[1:], dtype=np.float64)
    return (total[offs[1:]] - total[offs[:-1]]).argmax(1)


def raw_and_language(model: Model, column: pa.Array, most_words: int = 60_000) -> tuple[np.ndarray, np.ndarray]:
    """Logit before calibration and index of the likeliest language of each text; about `most_words` words are worked on at once."""
    z, lang = np.zeros(len(column)), np.zeros(len(column), np.int64)
    ids, offs = word_ids(column, model.buckets)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most_words, "right")) - 1)
        at = offs[lo : hi + 1]
        part, own = ids[at[0] : at[-1]], at - at[0]
        z[lo:hi], lang[lo:hi] = raw_scores(model, part, own), guess_language(model, part, own)
        lo = hi
    return z, lang


def scores(model: Model, column: pa.Array) -> np.ndarray:
    """Calibrated score of each text, 0 to 1."""
    z, lang = raw_and_language(model, column)
    return 1 / (1 + np.exp(-np.clip(z - model.shift[lang], -30, 30)))


def _best_threshold(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Logit between the two neighbours with the best F1 (the middle of a gap); toxic and clean: weights of rows at each z."""
    z, at = np.unique(z, return_inverse=True)
    toxic, clean = np.bincount(at, toxic)[::-1], np.bincount(at, clean)[::-1]
    z, hits = z[::-1], np.cumsum(toxic)
    f1 = 2 * hits / (np.cumsum(toxic + clean) + toxic.sum())
    i = int(len(f1) - 1 - f1[::-1].argmax())
    after = z[i + 1] if i + 1 < len(z) else z[i] - 1
    return float((z[i] + after) / 2)


Params = dict[str, np.ndarray]


def initial(rng: np.random.Generator, buckets: int, dim: int, filters: int) -> Params:
    """e: embeddings; w<width><position>: filters; b: their biases; o, c: the logistic unit."""
    k = filters * len(WIDTHS)
    params = {"e": rng.normal(0, 0.005, (buckets, dim)), "o": rng.normal(0, 0.3, k), "c": np.zeros(1), "b": np.zeros(k)}
    params |= {f"w{w}{j}": rng.normal(0, 0.4, (dim, filters)) for w in WIDTHS for j in range(w)}
    params["e"][0] = 0
    return {k: v.astype(np.float32) for k, v in params.items()}


def loss_and_gradients(params: Params, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> tuple[float, Params, np.ndarray, np.ndarray]:
    """Weighted mean log loss of texts (bucket pairs, at least one word each), gradients of all but e, and the rows of e touched with theirs.

    drop: factors of the pooled features, a row a text.
    """
    dim, f = params["w10"].shape
    wide = max(WIDTHS) - 1
    pad = np.zeros((wide, 2), np.int32)
    flat = np.concatenate([x for t in texts for x in (t, pad)])
    start = np.concatenate([[0], np.cumsum([len(t) + wide for t in texts])])
    emb = params["e"][flat].sum(1)
    m = len(flat) - wide
    pooled, where = np.zeros((len(texts), f * len(WIDTHS)), emb.dtype), []
    for k, w in enumerate(WIDTHS):
        r = emb[:m] @ params[f"w{w}0"]
        for j in range(1, w):
            r += emb[j : m + j] @ params[f"w{w}{j}"]
        for i in range(len(texts)):
            a, z = start[i], start[i + 1] - wide
            at = r[a:z].argmax(0) + a
            pooled[i, k * f : (k + 1) * f] = r[at, np.arange(f)]
            where.append((i, k, w, at))
    hidden = np.maximum(pooled + params["b"], 0)
    z = (hidden * drop) @ params["o"] + params["c"]
    loss = float((weight * (np.logaddexp(0, z) - y * z)).mean())
    gap = ((1 / (1 + np.exp(-z)) - y) * weight / len(texts)).astype(emb.dtype)
    grads = {k: np.zeros_like(v) for k, v in params.items() if k != "e"}
    grads["o"] = (hidden * drop).T @ gap
    grads["c"][0] = gap.sum()
    back = gap[:, None] * params["o"] * drop * (hidden > 0)
    grads["b"] = back.sum(0)
    touched, touch = [np.zeros(0, np.int32)], [np.zeros((0, dim), emb.dtype)]
    for i, k, w, at in where:
        g = back[i, k * f : (k + 1) * f]
        on = np.flatnonzero(g)
        for j in range(w):
            grads[f"w{w}{j}"][:, on] += emb[at[on] + j].T * g[on]
            touched += [flat[at[on] + j, 0], flat[at[on] + j, 1]]
            touch += [g[on, None] * params[f"w{w}{j}"][:, on].T] * 2
    spots, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    own = np.zeros((len(spots), dim), emb.dtype)
    np.add.at(own, inverse, np.concatenate(touch))
    own[spots == 0] = 0  # the padding stays at zero
    return loss, grads, spots, own


def as_model(params: Params) -> Model:
    """The network for scoring, with no languages yet."""
    buckets = len(params["e"])
    return Model(buckets, [[params["e"] @ params[f"w{w}{j}"] for j in range(w)] for w in WIDTHS], params["b"], params["o"], float(params["c"][0]), np.zeros((buckets, 0), np.float32), np.zeros(1))


def thinned(text: np.ndarray, rng: np.random.Generator, share: float) -> np.ndarray:
    """A text without a random share of its words, so that no single word carries it; at least one word stays."""
    stays = rng.random(len(text)) >= share
    return text[stays] if stays.any() else text


def fit(ids: np.ndarray, offs: np.ndarray, labels: np.ndarray, langs: np.ndarray, buckets: int, dim: int = 12, filters: int = 8, epochs: int = 5, least_steps: int = 150, decay: float = 1e-3, lost: float = 0.3, seed: int = 5) -> Model:
    """Trains the network, without thresholds; langs are indexes of languages, -1 for none."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    params = initial(rng, buckets, dim, filters)
    own = np.flatnonzero(np.diff(offs) > 0)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    share = labels.mean()
    step = 0
    for _ in range(max(epochs, -(-least_steps // max(1, len(own) // 64)))):
        rng.shuffle(own)
        for batch in np.array_split(own, max(1, len(own) // 64)):
            step += 1
            y = labels[batch]
            weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
            drop = (rng.random((len(batch), filters * len(WIDTHS))) > 0.2).astype(np.float32) / np.float32(0.8)
            _, grads, spots, g = loss_and_gradients(params, [thinned(ids[offs[i] : offs[i + 1]], rng, lost) for i in batch], y, weight, drop)
            g += decay * params["e"][spots]
            first["e"][spots] += 0.1 * (g - first["e"][spots])
            second["e"][spots] += 0.02 * (g * g - second["e"][spots])
            params["e"][spots] -= 0.02 * first["e"][spots] / (np.sqrt(second["e"][spots]) + 1e-6)
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.02 * (g * g - second[name])
                params[name] -= 0.01 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.98**step)) + 1e-6)
    out = as_model(params)
    # words by language, by naive Bayes
    m = int(langs.max()) + 1 if len(langs) else 0
    count = np.full((buckets, max(m, 1)), 0.5)
    row = np.repeat(np.arange(n), np.diff(offs))
    known = langs[row] >= 0
    if m:
        np.add.at(count, (ids[known, 0], langs[row][known]), 1)
    out.lang_words = np.log(count / count.sum(0)).astype(np.float32)
    out.shift = np.zeros(max(m, 1))
    return out


BINS, WIDEST = 128, 64  # score bins a unit of the logit, and the largest logit that is told apart


def calibrate(model: Model, docs: DataFrame, text: str, marked: DataFrame, fitted: DataFrame, threshold: float = 0.3, prior: float = 20.0) -> Model:
    """Sets the shift of each language from the scores of all labelled rows (marked: doc_id, __label) that are not fitted (doc_id).

    Scores meet labels, so no text is shuffled.  A language's own shift is drawn towards that of all rows as if `prior` of
    its toxic rows had asked for the latter; one without toxic or without clean rows has only that.
    """
    rows = docs.where(F.col(text).isNotNull())
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang int, bin int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z, lang = raw_and_language(shared.value, pa.array(batch, pa.large_string(), from_pandas=True))
            yield pd.DataFrame({"lang": lang.astype(np.int32), "bin": np.floor(np.clip(z, -WIDEST, WIDEST) * BINS).astype(np.int32)})
        release()

    known = marked.join(F.broadcast(fitted.select("doc_id", F.lit(True).alias("__fitted"))), "doc_id", "left")
    met = rows.select("doc_id", scored(text).alias("s")).join(known, "doc_id")
    counts = met.groupBy("s.lang", "s.bin", "__label").agg(F.count_if(F.col("__fitted").isNull()).alias("c"), F.count("*").alias("all")).toPandas()  # languages x bins x labels at most
    y, c = counts["__label"].to_numpy(np.int64), counts["c"].to_numpy(np.float64)
    got, totals = ({k: x[y == k].sum() for k in (0, 1)} for x in (c, counts["all"]))
    counts, y, c = counts[c > 0], y[c > 0], c[c > 0]
    if not (got[0] and got[1]):
        return model
    weight = [np.where(y == k, c * totals[k] / got[k], 0.0) for k in (1, 0)]
    z, lang = (counts["bin"].to_numpy() + 0.5) / BINS, counts["lang"].to_numpy()
    goal = np.log(threshold / (1 - threshold))
    model.shift[:] = _best_threshold(z, *weight) - goal
    for k in range(len(model.shift)):
        own = lang == k
        toxic, clean = (c[own & (y == v)].sum() for v in (1, 0))
        if toxic and clean:
            alone = _best_threshold(z[own], weight[0][own], weight[1][own]) - goal
            model.shift[k] += (alone - model.shift[k]) * toxic / (toxic + prior)
    return model


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", label: str = "toxic", rows_per_label: int = 2500, words_per_label: int = 2_000_000, buckets: int = 1 << 16) -> Model | None:
    """Fits on about `rows_per_label` rows of each label (a bounded sample chosen by a hash of the id) and calibrates on all others.

    A quarter of the ids, by another hash, is never fitted on, so that small tables have rows to calibrate on too.

    The sampled rows are hashed to word buckets on the executors and learned from as whole texts; of each label as many,
    in the order of the hash, as hold `words_per_label` words together, so the driver gets 32 MB at most.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("__label"))  # repeated rows: toxic once is toxic
    chosen = keep(by_label(marked.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) > 0), "__label", rows_per_label), "sample")
    rows = docs.select("doc_id", text, lang).where(F.col(text).isNotNull()).join(F.broadcast(chosen), "doc_id")  # bounded by rows_per_label

    @F.pandas_udf("binary")
    def hashed(column: pd.Series) -> pd.Series:
        ids, offs = word_ids(pa.array(column, pa.large_string(), from_pandas=True), buckets)
        return pd.Series([ids[a:b].tobytes() for a, b in zip(offs, offs[1:])])

    held = keep(rows.select("doc_id", F.col("__label").alias("y"), F.col(lang).alias("lang"), hashed(text).alias("ids")), "hashed")
    so_far = F.sum(F.octet_length("ids") / 8).over(W.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "ids"))  # some thousand rows
    fitted = held.where(F.octet_length("ids") <= 8 * words_per_label).withColumn("so_far", so_far).where(F.col("so_far") <= words_per_label)
    got = sorted(fitted.collect(), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    if len({r["y"] for r in got}) < 2:
        return None
    names = sorted({r["lang"] for r in got if r["lang"] is not None})
    parts = [np.frombuffer(r["ids"], np.int32).reshape(-1, 2) for r in got]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    model = fit(np.concatenate(parts), offs, np.array([r["y"] for r in got]), np.array([names.index(r["lang"]) if r["lang"] is not None else -1 for r in got]), buckets)
    return calibrate(model, docs, text, marked, fitted.select("doc_id").distinct())


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (double) and predicted (1 if score >= threshold); columns of these names are replaced."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, by buckets and filters

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(shared.value, pa.array(batch, pa.large_string(), from_pandas=True)))
        release()

    out = docs.withColumn("score", run(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
