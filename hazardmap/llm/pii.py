"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) always count.  The field adds what they miss, such as
"jo dot doe at site dot org", "(988) 555-2485" or an access token (kind secret): words are seen only by their
shape (length, digits, dots, dashes, brackets, case, a few cue words) and that of their neighbours, weights are
learned from a small labelled table, and the best labelling comes from Viterbi over whole batches in numpy.  A
found span must also be complete (an address needs a host with a dot, a phone 9 to 15 digits, a card 12 to 19
digits passing Luhn, an ip four parts up to 255, a secret 16 characters or more with letters and digits) and must
not touch a pattern's span.

A sequence is one line of a text, whatever its length; what stands beside it in a batch changes nothing.

Null and empty texts have no spans.  Repeated rows give repeated results; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import release, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # the same matches as without the look-behind, in linear time
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(rb"[A-Za-z0-9+/_-]+")
_HOST = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*")
_PATH_SECRET = re.compile(rb"[A-Za-z0-9+_-]+")
#: Written-out signs, which are words of their own even inside a word.
_SIGN = re.compile(rb"[(\[](?:at|dot)[)\]]", re.I)

#: Cue words of the shapes; any other word is known by its shape alone.
CUES = ("at", "(at)", "[at]", "dot", "(dot)", "[dot]", "phone", "tel", "call", "fax", "mobile", "card", "visa", "mail", "email", "ip", "host", "contact", "token", "key", "secret", "password", "apikey", "api_key", "=", "commit", "version")

#: The labelled table: spans are marked as kind{...}.
LABELLED = (
    "write to email{jo dot doe at site dot org} before noon",
    "reach me: email{ann.lee (at) corp (dot) net} or later",
    "contact email{max at home dot de} for more",
    "my mail is email{sam_b [at] web [dot] com}",
    "email{kim (at) lab dot edu} wrote this",
    "send it by email to email{info at shop dot co dot uk} please",
    "email email{a.b (at) example.org} now",
    "email{jane.doe(at)example.com} is not found by a pattern",
    "or email{info[at]lab[dot]edu}, they say",
    "ask email{j_smith(at)shop(dot)de} for it",
    "you can reach email{mary at example dot org} all day and they will answer",
    "ask email{peter_p at club dot it} or the man at the door",
    "send word to email{ops at data-hub dot io} by noon",
    "mail email{x.lang at site dot co} when you are at home",
    "she looked at the dot on the wall and left",
    "we met at noon at the station",
    "look at that, a dot at the end",
    "contact us at the front door",
    "the mail came at ten and he was at home",
    "write to email{x.y@host.org} before noon",
    "email{bob77@mail.example.com} wrote this and left",
    "call phone{(988) 555-2485} after six",
    "phone phone{555-201-8844} or ask",
    "tel phone{030 5551 88203} office",
    "our fax: phone{(030) 555 77 88 99}",
    "mobile phone{0171-5550199} only",
    "ring phone{+1 (212) 555-0100} today",
    "dial phone{+49 30 5550 1234} for help",
    "call phone{212.555.0199} now",
    "in 1999 there were 12 or 13 of them",
    "the 555 men walked 20 miles in 2 days",
    "version 3.5 of 2019-10-04 has 12,000 lines",
    "order 20391 cost 19.95 on 04/05/2021",
    "pages 100-120 and 300-310 of volume 7",
    "from 1914-1918 to 1939-1945 and on",
    "section 4.0. of the text",
    "the code 9f8e7d6c5b4a is not one",
    "token = secret{0641917ea4e9feb9cda83477b57} was set",
    'token = secret{"9b1c64a9a4cd9723e1f4eafc27395915e6868ffb"} and more words',
    'the token = secret{"a7b0ede43f42c939b6405768150e0411590525cf"}.',
    "with key secret{f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda} it opens",
    "key secret{0b4fb7d0c1a64c09a1c8d5e37f12ab90} und mehr",
    "use key secret{KEY12AB34CD56EF78GH} for it",
    "secret = secret{q7Wm2ZxT9pLk4RvN8sBd} he wrote",
    "api_key = secret{sk_live_4f9a8b7c6d5e4f3a2b1c} stands there",
    "password secret{Tr0ub4dor3xKq9Zm7Yw} was lost",
    "export apikey = secret{ghp_16C7e42F292c6912E7710c838347Ae178B4a}",
    "the secret was kept and the key was lost",
    "a token of thanks = nothing",
    "version 20210405123456789 of the page",
    "word### other*** more%%% and then&&& some",
    "an unbelievablylongwordwithoutanydigits stands here",
    "ERR_CONNECTION_REFUSED and misunderstandings everywhere",
    "build 20210405123456 passed in 3 min",
    "see https://site.org/2021/04/a-long-title-of-words and more",
    "(at) the end of it (dot) he stood",
    "host ip{10.1.2.3} was down",
    "ip ip{192.168[.]10[.]4} blocked",
    "from ip{70.123.182.155} came a call",
    "the host ip{8[.]8[.]8[.]8} answers",
    "traffic of ip{203[.]118[.]254[.]101} was seen in 2004",
    "ip ip{172[.]16[.]200[.]17} and ip{45[.]90[.]2[.]133} are out",
    "card card{4041894974608795} was charged",
    "visa card{4041.8949.7460.8795} expired",
    "pay card{4041-8949-7460-8795} again",
    "card number card{4041 8949 7460 8795} ok",
    "with card card{4041/8949/7460/8795} and left",
    "this and that were here and there in the old town",
    "He said that nothing of this kind had been seen before.",
    "A | B | C && D ### $$$ *** more",
    "And then, ALL OF THEM!! left!!",
)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code of each word's shape: the columns of _WIDTHS as one mixed-radix number."""
    kind = _CLASS[data]
    count = lambda c: np.diff(np.concatenate([[0], np.cumsum(kind == c, dtype=np.int32)])[np.stack([starts, ends])], axis=0)[0]
    digits, dots, dashes, ats, plus, brackets, lower, upper, other = (count(c) for c in range(1, 10))
    letters = lower + upper
    case = np.select([letters == 0, upper == 0, (upper == 1) & (kind[starts] == 8)], [0, 1, 2], 3)
    cue = np.zeros(len(starts), np.int64)
    short = np.flatnonzero(ends - starts <= 9)
    h = tx.span_hash(data, starts[short], _trimmed(data, starts[short], ends[short]))
    known, at = _cue_hashes()
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[i] == h
    cue[short[hit]] = at[i[hit]]
    columns = (np.digitize(digits, (1, 2, 3, 4, 5, 8, 12, 20)), np.minimum(dots, 3), np.minimum(dashes, 2), ats > 0, plus > 0, brackets > 0, other > 0, case, cue, np.digitize(ends - starts, (4, 8, 16, 24)))
    code = np.zeros(len(starts), np.int64)
    for x, w in zip(columns, _WIDTHS):
        code = code * w + x
    return code


_WIDTHS = (9, 4, 3, 2, 2, 2, 2, 4, len(CUES) + 1, 5)
_CLASS = np.full(256, 9, np.uint8)
for _c, _set in enumerate((b"0123456789", b".", b"-", b"@", b"+", b"()[]", bytes([*range(97, 123), *range(128, 256)]), bytes(range(65, 91))), 1):
    _CLASS[list(_set)] = _c
_CLASS[list(b",;:!?\"'")] = 0
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.where(_TAIL[data[ends - 1]] & (ends - starts > 1), ends - 1, ends) if len(starts) else ends


@lru_cache(1)
def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    data, offs = tx.buffers(pa.array([" ".join(CUES)]))
    s, e, _ = tx.words(data, offs)
    h = tx.span_hash(data, s, e)
    order = np.argsort(h)
    return h[order], order + 1


def field_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words that the field sees: as of tx.words, cut before and after written-out signs."""
    starts, ends, row = tx.words(data, offs)
    cuts = np.array([x for m in _SIGN.finditer(data.tobytes()) for x in m.span()], np.int64)
    if not len(cuts) or not len(starts):
        return starts, ends, row
    at = np.searchsorted(starts, cuts, "right") - 1
    cuts = np.unique(cuts[(at >= 0) & (starts[at] < cuts) & (cuts < ends[at])])
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _features(code: np.ndarray) -> np.ndarray:
    """Indexes of the features of each shape code: one per column and five joint ones."""
    columns, rest = [], code
    for w in _WIDTHS[::-1]:
        columns.append(rest % w)
        rest = rest // w
    digits, dots, dashes, ats, plus, brackets, other, case, cue, size = columns[::-1]
    joint = (digits * 4 + dots, (digits * 3 + dashes) * 2 + brackets, (cue * 9) + digits, (((dots * 2 + ats) * 4 + case) * 2 + plus) * 2 + other, (digits * 4 + case) * 5 + size)
    out, base = [], 0
    for x, w in zip((digits, dots, dashes, ats, plus, brackets, other, case, cue, size, *joint), (*_WIDTHS, *_JOINT)):
        out.append(x + base)
        base += w
    return np.stack(out, 1)


_JOINT = (36, 54, 9 * (len(CUES) + 1), 128, 180)
_N_FEATURES = sum(_WIDTHS) + sum(_JOINT)


def parse_labelled(lines: tuple[str, ...] = LABELLED) -> list[tuple[str, list[int]]]:
    """(text, label of each word) of marked lines."""
    words = lambda x: len(field_words(*tx.buffers(pa.array([x])))[0])
    out = []
    for line in lines:
        plain, labels, at = "", [], 0
        for m in [*re.finditer(r"(email|ip|card|phone|secret)\{([^}]*)\}", line), None]:
            before = line[at : m.start() if m else None]
            labels += [0] * words(before)
            plain += before + (m[2] if m else "")
            if m:
                labels += [LABELS.index(m[1])] * words(m[2])
                at = m.end()
        out.append((plain, labels[: words(plain)]))
    return out


@lru_cache(1)
def train(steps: int = 250, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the field (three tables by feature and label; transitions), by Adam on the exact log-likelihood."""
    table = parse_labelled()
    n, t, m = len(table), max(len(y) for _, y in table), len(LABELS)
    codes, y, mask = np.zeros((n, t), np.int64), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (line, labels) in enumerate(table):
        data, offs = tx.buffers(pa.array([line]))
        s, e, _ = field_words(data, offs)
        codes[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = _shapes(data, s, e), labels, True
    f = _features(codes.ravel()).reshape(n, t, -1)
    weights, trans = np.zeros((3, _N_FEATURES, m)), np.zeros((m, m))
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (weights, trans)]
    near = [(slice(None), slice(None)), (slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))]  # own, previous and next word
    gold = np.eye(m)[y] * mask[..., None]
    for step in range(1, steps + 1):
        emit = np.zeros((n, t, m))
        for k, (to, of) in enumerate(near):
            emit[:, to] += (weights[k][f[:, of]].sum(2)) * mask[:, of, None]
        a, b = np.zeros((n, t, m)), np.zeros((n, t, m))
        a[:, 0] = emit[:, 0]
        for j in range(1, t):
            a[:, j] = np.where(mask[:, j, None], np.logaddexp.reduce(a[:, j - 1, :, None] + trans, 1) + emit[:, j], a[:, j - 1])
        for j in range(t - 2, -1, -1):
            b[:, j] = np.where(mask[:, j + 1, None], np.logaddexp.reduce(trans + (emit[:, j + 1] + b[:, j + 1])[:, None, :], 2), b[:, j + 1])
        z = np.logaddexp.reduce(a[:, -1], 1)
        gap = gold - np.exp(a + b - z[:, None, None]) * mask[..., None]
        both = mask[:, 1:] & mask[:, :-1]
        pair = np.exp(a[:, :-1, :, None] + trans + (emit + b)[:, 1:, None, :] - z[:, None, None, None])
        grads = [np.zeros_like(weights), ((gold[:, :-1, :, None] * gold[:, 1:, None, :] - pair) * both[..., None, None]).sum((0, 1)) - l2 * trans]
        for k, (to, of) in enumerate(near):
            g = gap[:, to] * mask[:, of, None]
            for j in range(f.shape[2]):
                np.add.at(grads[0][k], f[:, of, j], g)
        grads[0] -= l2 * weights
        for w, g, (first, second) in zip((weights, trans), grads, state):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights.astype(np.float32), trans.astype(np.float32)


def emissions(weights: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores (own, previous and next word's part; word; label) of shape codes, worked out once for each code that occurs."""
    seen, at = np.unique(codes, return_inverse=True)
    table = np.zeros((3, len(seen), len(LABELS)), np.float32)
    for column in _features(seen).T:
        table += weights[:, column]
    return table[:, at]


def viterbi(emit: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of the words of sequences; emit has a row a word, sequence i has size[i] > 0 rows from first[i] on.

    All sequences go forward together, the longest first in order, so that at each step those that still run stand in front.
    """
    n, m = emit.shape
    order = np.argsort(-size, kind="stable")
    at, left = first[order], size[order]
    steps = int(left[0]) if len(left) else 0
    running = np.searchsorted(-left, -np.arange(steps), "left")  # sequences longer than j
    back = np.zeros((n, m), np.int8)
    score = emit[at]
    for j in range(1, steps):
        k = running[j]
        step = score[:k, :, None] + trans
        back[at[:k] + j] = step.argmax(1)
        score[:k] = step.max(1) + emit[at[:k] + j]
    out = np.empty(n, np.int8)
    label = score.argmax(1).astype(np.int8)
    out[at + left - 1] = label
    for j in range(steps - 1, 0, -1):
        k = running[j]
        label[:k] = back[at[:k] + j, label[:k]]
        out[at[:k] + j - 1] = label[:k]
    return out


def label_words(codes: np.ndarray, seq: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Labels of words; seq numbers the sequence of each word, ascending."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int8)
    own, before, after = emissions(weights, codes)
    same = seq[1:] == seq[:-1]
    own[1:] += before[:-1] * same[:, None]
    own[:-1] += after[1:] * same[:, None]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return viterbi(own, first, np.diff(np.append(first, n)), trans)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, looked for only where an @ stands."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the patterns, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_DOT = re.compile(r"\s*(?:[(\[]dot[)\]]|\bdot\b|\.)\s*", re.I)
_AT = re.compile(r"\s*(?:[(\[]at[)\]]|\bat\b|@)\s*", re.I)


def complete(kind: int, found: str) -> bool:
    """Does a span that the field found hold a whole item of its kind?"""
    if kind == 1:
        found = " ".join(found.split())  # white space of any length is one space, so time stays linear
        parts = _AT.split(found)
        if len(parts) != 2 or not parts[0]:
            return False
        host = _DOT.split(parts[1])
        return len(host) >= 2 and all(re.fullmatch(r"[A-Za-z0-9-]+", p) for p in host) and not re.search(r"\s", _DOT.sub(".", parts[0])) and ("@" in found or bool(re.search(r"\bdot\b|[\])]", found, re.I)))
    if kind == 5:
        return len(found) >= 16 and bool(_HAS_DIGIT.search(found)) and bool(re.search(r"[A-Za-z]", found))
    digits = _NOT_DIGIT.sub("", found)
    if kind == 2:
        parts = re.split(r"[\[(]?\.[\])]?", found)
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 3:
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", found)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[0-9][ ().-]+[0-9]", found)) and bool(re.fullmatch(r"[0-9 ().+/-]+", found)) and not re.fullmatch(r"[0-9]{4}-[0-9]{4}", found)


def find_spans(column: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Pattern spans and all spans, (start, kind, end) in code points, of each text."""
    data, offs = tx.buffers(column)
    base: list[list] = []
    extra: list[list] = [[] for _ in range(len(column))]
    for lo, hi, part, at in tx.slices(data, offs):
        starts, ends, row = field_words(part, at)
        lines = np.cumsum(part == 10)
        seq = row * (len(part) + 1) + (lines[starts] if len(starts) else 0)
        seq = np.cumsum(np.concatenate([[0], seq[1:] != seq[:-1]])) if len(seq) else seq
        labels = label_words(_shapes(part, starts, ends), seq, *model)
        hot = np.flatnonzero(labels)
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)]) if len(hot) else None
        runs = np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (np.diff(labels[hot]) != 0) | (np.diff(seq[hot]) != 0)) + 1) if len(hot) else []
        for run in runs:
            i, j, r = int(starts[run[0]]), int(ends[run[-1]]), int(row[run[0]])
            raw = part[i:j].tobytes()
            left, right = len(raw) - len(raw.lstrip(b"\"'<,;:")), len(raw.rstrip(b"\"'>.,;:!?"))
            if labels[run[0]] == 5:  # of a URL only what follows its host
                host = _HOST.search(raw)
                found = _PATH_SECRET.finditer(raw, host.end()) if host else _SECRET.finditer(raw)
                m = max(found, key=lambda m: m.end() - m.start(), default=None)
                left, right = m.span() if m else (0, 0)
            if left < right and complete(int(labels[run[0]]), raw[left:right].decode(errors="replace")):
                zero = points[at[r]]
                extra[lo + r].append((int(points[i + left] - zero), int(labels[run[0]]) - 1, int(points[i + right] - zero)))
    for text in column.to_pylist():
        base.append(base_spans(text) if text else [])
    every = []
    for own, more in zip(base, extra):
        free = [x for x in more if all(x[2] <= b[0] or x[0] >= b[2] for b in own)]
        every.append(sorted({*own, *free}))
    return base, every


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (of the patterns), n_spans (of all), base_spans and spans
    (kind:start:end, comma-joined), and with `redacted` also redacted_text.  Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    model = train()
    schema = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,n_spans:long,base_spans:string,spans:string" + (",redacted_text:string" if redacted else "") + ">"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, every = find_spans(pa.array(batch, pa.large_string(), from_pandas=True), model)
            out = pd.DataFrame({f"n_{kind}": np.array([sum(s[1] == k for s in x) for x in base], np.int64) for k, kind in enumerate(KINDS[:4])})
            out["n_spans"] = np.array([len(x) for x in every], np.int64)
            out["base_spans"], out["spans"] = [joined(x) for x in base], [joined(x) for x in every]
            if redacted:
                out["redacted_text"] = [redact(t, x) if isinstance(t, str) else None for t, x in zip(batch, every)]
            yield out
        release()

    found = docs.withColumn("__pii", run(F.col(text)))
    names = ["n_email", "n_ip", "n_card", "n_phone", "n_spans", "base_spans", "spans"] + ["redacted_text"] * redacted
    return found.withColumns({n: F.col(f"__pii.{n}") for n in names}).drop("__pii")
