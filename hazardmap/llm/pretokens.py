"""Pre-tokens and merges of byte-level BPE vocabularies, and the ids of texts."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex

_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc\xbd\xbe", "\t-\r \x85\xa0"
#: The public byte-level pattern, once with the classes of Latin-1 spelled out and once by Unicode property.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_S_U = r"\p{White_Space}"
_UNICODE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S_U}\p{{L}}\p{{N}}]+|[{_S_U}]+(?![^{_S_U}])|[{_S_U}]+")
_WIDE = re.compile("[^\x00-\xff]")


def pretokens(text: str) -> list[str]:
    return (_UNICODE if _WIDE.search(text) else _LATIN).findall(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def merges(path: str) -> tuple[dict[tuple[str, str], tuple[int, str]], list[str]]:
    """Rank and result of each merge, and the printable character of each byte, from a tokenizer's JSON."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    shown = {b: chr(b) for b in plain}
    letters = [shown.get(b) or chr(next(spare)) for b in range(256)]
    return {(a, b): (i, a + b) for i, (a, b) in enumerate(pairs)}, letters


@lru_cache(4)
def special(path: str) -> re.Pattern[str] | None:
    """The added tokens of a tokenizer's JSON, each one token wherever it stands in a text; None if there are none."""
    with open(path, encoding="utf-8") as f:
        found = [t["content"] for t in json.load(f)["added_tokens"]]
    return re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True)))) if found else None


@lru_cache(2)
def encoding(path: str):
    """The vocabulary of a byte-level tokenizers JSON as a tiktoken encoding: in such files ids follow the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    byte = {c: b for b, c in enumerate(merges(path)[1])}
    ranks = {bytes(byte[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str, path: str) -> bytes:
    """The ids of a text, 4 bytes each; added tokens inside a text are special tokens, as by default in the library."""
    return encoding(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
