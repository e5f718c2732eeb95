"""Language by cross-parsing entropy.

Of each language a bounded sample of labelled text is kept and turned into a suffix automaton.  An unseen
text is parsed greedily against each: a phrase is the longest match of what comes next in the sample.
The fewer phrases a text needs, the closer it is; each count is normalised by the entropy scale
log2(sample length), so cost = phrases * log2(sample length) / symbols, and the cheapest language wins.

The automata are laid out as dense tables (state x symbol -> state, with a flag where a phrase ends), so
one numpy step advances all texts of a batch by one symbol in all languages.  Blocks of 512 symbols of long
texts are first parsed side by side, each as if it began the text; then each is parsed again from the state in
which the block before ends, only until both parses meet, which gives the phrases of the whole text exactly.
Symbols are lower-case letters; anything else is one space, runs of spaces count once.

Null texts and texts without a letter get `und` and score 0.  With no labelled rows every text is `und`.
Ties go to the language first by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import by_label
from .store import keep, release, small_batches

BLOCK = 512
UNKNOWN = "und"


@lru_cache(1)
def _folds() -> np.ndarray:
    """Lower-case letter of each code point below 0x110000, 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x30000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(text: str) -> np.ndarray:
    """Code points of the lower-case letters of a text, with one space between words."""
    x = _folds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    return x[keep]


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the automaton of all substrings: state x symbol -> state or -1."""
    n = len(symbols)
    table = np.full((2 * n + 2, width), -1, np.int32)
    link, length, size, last = [-1] * (2 * n + 2), [0] * (2 * n + 2), 1, 0
    go: list[dict[int, int]] = [{} for _ in range(2 * n + 2)]
    for c in symbols:
        new, size = size, size + 1
        length[new] = length[last] + 1
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin, size = size, size + 1
                length[twin], go[twin], link[twin] = length[p] + 1, dict(go[q]), link[q]
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    for s in range(size):
        if go[s]:
            table[s, list(go[s].keys())] = list(go[s].values())
    return table[:size]


class Parser:
    """Counts phrases of texts against the samples of all languages at once."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        own = {k: folded(samples[k]) for k in self.langs}
        letters = np.unique(np.concatenate([*own.values(), [32]]).astype(np.uint32))
        self.width = len(letters) + 2  # the last but one: any other letter; the last: padding
        self.symbol = np.full(0x110000, len(letters), np.uint16)
        self.symbol[letters] = np.arange(len(letters))
        tables, base = [], 0
        self.start = []
        for k in self.langs:
            t = suffix_automaton(self.symbol[own[k]].tolist(), self.width)
            dead = len(t) + base  # after a symbol that the sample lacks, a phrase of its own
            root = np.where(t[0] >= 0, t[0] + base, dead)
            full = np.where(t >= 0, t + base, root[None, :] | (1 << 30))  # the flag: a phrase ended here
            full = np.concatenate([full, (root | (1 << 30))[None, :]])
            full[0] = root
            full[:, -1] = np.arange(len(full)) + base
            tables.append(full.astype(np.int32))
            self.start.append(base)
            base += len(full)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.scale = np.array([np.log2(max(2, len(own[k]))) for k in self.langs])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each folded text (rows) by language (columns)."""
        sizes = [max(1, -(-len(t) // BLOCK)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        blocks = np.full((len(owner), BLOCK), self.width - 1, np.uint16)
        at = 0
        for t, k in zip(texts, sizes):
            flat = blocks[at : at + k].reshape(-1)
            flat[: len(t)] = self.symbol[t]
            at += k
        length = (blocks != self.width - 1).sum(1)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        blocks, length = np.ascontiguousarray(blocks[order].T), length[order]
        n, m = len(owner), len(self.langs)
        state = np.repeat(np.array(self.start, np.int32)[:, None], n, 1)
        count = np.zeros((m, n), np.int32)
        alive = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than step j
        steps = int(length[0]) if n else 0
        seen = np.empty((steps, m, n), np.int32)  # state and flag after each symbol
        for j in range(steps):
            k = alive[j]
            to = self.table[state[:, :k] * self.width + blocks[j, :k]]
            seen[j, :, :k] = to
            count[:, :k] += to >> 30
            state[:, :k] = to & _STATE
        # from the state in which the block before ends, until both parses meet
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(m), later, indexing="ij"))
        more = np.zeros((m, n), np.int32)
        while len(block):
            own, st = place[block], state[lang, place[block - 1]]
            extra, changed = np.zeros(len(block), np.int32), np.zeros(len(block), bool)
            on = np.arange(len(block))
            for j in range(steps):
                on = on[length[own[on]] > j]
                if not len(on):
                    break
                to = self.table[st[on] * self.width + blocks[j, own[on]]]
                was = seen[j, lang[on], own[on]]
                extra[on] += (to >> 30) - (was >> 30)
                st[on] = to & _STATE
                apart = st[on] != was & _STATE
                changed[on] = apart
                on = on[apart]
            more[lang, own] = extra
            state[lang, own] = np.where(changed, st, seen[length[own] - 1, lang, own] & _STATE)
            nxt = changed & (block + 1 < n) & (owner[np.minimum(block + 1, n - 1)] == owner[block])
            lang, block = lang[nxt], block[nxt] + 1  # those after a block that never met its first parse
        count += more
        out = np.zeros((len(texts), m), np.int64)
        for i in range(m):
            out[:, i] = np.bincount(owner[order], count[i], len(texts))
        return out + (np.array([len(t) for t in texts]) > 0)[:, None]  # the phrase that the text's end cuts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (share of the winner among exp(-cost)) of each text."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        part: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if part:
                cost = self.phrases([x for _, x in part]) * self.scale / np.array([[len(x)] for _, x in part])
                odds = np.exp(-4 * (cost - cost.min(1, keepdims=True)))
                for (i, _), b, s in zip(part, cost.argmin(1), odds.max(1) / odds.sum(1)):
                    lang[i], score[i] = self.langs[b], float(s)
                part.clear()

        held = 0
        for i, t in enumerate(texts if self.langs else []):
            x = folded(t) if isinstance(t, str) and t else _NOTHING
            if (x != 32).any():
                part.append((i, x))
                held += max(BLOCK, len(x))
                if held > 500_000:
                    flush()
                    held = 0
        flush()
        return lang, score


_STATE = (1 << 30) - 1
_NOTHING = np.zeros(0, np.uint32)
_parsers: dict[bytes, Parser] = {}


def parser_for(key: bytes, shared) -> Parser:
    """The parser of a broadcast of samples, built once per worker."""
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(shared.value)
    return _parsers[key]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = 400, chars: int = 40_000) -> dict[str, str]:
    """A sample of whole texts by language: of about `rows` rows each, chosen by a hash of the id, as many as `chars` characters hold.

    The shortest of them is always taken.  The bounds hold whatever the table's size.
    """
    clean = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    found = keep(by_label(clean.select("doc_id", lang, text), lang, rows).select("doc_id", F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.length(text).alias("n"), F.col(text).alias("text")), "sample")
    room: dict[str, int] = {}
    chosen: list[tuple[str, int]] = []
    listed = sorted(found.select("lang", "doc_id", "h", "n").distinct().collect(), key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).digest(), r["h"]))
    for r in [*(min((x for x in listed if x["lang"] == k), key=lambda x: x["n"]) for k in {x["lang"] for x in listed}), *listed]:
        if (r["lang"], r["h"]) not in chosen and (r["lang"] not in room or r["n"] < room[r["lang"]]):
            room[r["lang"]] = room.get(r["lang"], chars) - r["n"] - 1
            chosen.append((r["lang"], r["h"]))
    texts = {(r["lang"], r["h"]): r["text"] for r in found.where(F.col("h").isin([h for _, h in chosen])).select("lang", "h", "text").collect()}
    out: dict[str, list[str]] = {}
    for k, h in chosen:
        out.setdefault(k, []).append(texts[k, h])
    return {k: " ".join(v) for k, v in out.items()}


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).digest()
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by learn()

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = parser_for(key, shared)
        for batch in batches:
            lang, score = parser.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        release()

    out = docs.withColumn("__lang", run(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")
