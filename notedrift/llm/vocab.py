"""Byte-level vocabularies and exact encoding of many texts at once.

Both public file kinds of a byte-level BPE are read: ranks (one base64 token and
rank a line) and JSON (vocabulary and merges).  Pre-tokens are found with array
operations over code-point classes and are equal to the matches of
``public_tokenizers.PATTERN``; each distinct pre-token of a slice is merged once
by the tiktoken core and its ids are then copied to every place it stands.
Texts are first parted at the added tokens of a JSON vocabulary, whose ids stand
between those of the parts.
"""

from __future__ import annotations

import base64
import json
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken

from .textops import code_points, hash_runs

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Distinct pre-tokens a worker remembers between slices; past it the memory is emptied.
CACHE_TOKENS = 150_000


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        found = "".join(regex.findall(pattern, every))
        table[code_points(found)] = kind
    return table


@lru_cache(1)
def class_table() -> np.ndarray:
    return _classes()


def pretoken_starts(cps: np.ndarray) -> np.ndarray:
    """Start places of the pre-tokens of one text given as code points.

    The pattern, in words: a contraction ('s 't 're 've 'm 'll 'd); an optional
    blank before a run of letters, of numbers or of other signs; white space up
    to the last one before a sign; white space.
    """
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    kind = class_table()[cps]
    new = np.empty(n, bool)  # a run of one class starts here
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    start = new.copy()
    space = kind == SPACE
    # the last white space before a sign stands alone, and joins the sign if it is a blank
    last = np.flatnonzero(space[:-1] & ~space[1:])
    start[last] = True
    blank = last[cps[last] == 0x20]
    start[blank + 1] = False
    # contractions: an apostrophe that opens a token, and lower-case letters after it
    quote = np.flatnonzero((cps == 0x27) & start)
    if len(quote):
        quote = quote[quote + 1 < n]
        one = cps[quote + 1]
        two = np.where(quote + 2 < n, cps[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, np.array([ord(c) for c in "stmd"], np.uint32))
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for places, size in ((quote[short], 2), (quote[pair], 3)):
            start[places + 1] = False
            after = places + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of a byte-level BPE; ``token_bytes[i]`` are the raw bytes of id i.

    ``added``: ids of strings that are one token wherever they stand in a text;
    the leftmost counts, of those that start together the longest.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None):
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.added = added or {}
        self.find_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        size = max([*ranks.values(), *self.added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.token_bytes[i] = token
        self._ids: dict[int, bytes] = {}  # ids of a pre-token as 32-bit integers

    def _known(self, key: int, piece: str) -> bytes:
        got = self._ids.get(key)
        if got is None:
            if len(self._ids) >= CACHE_TOKENS:
                self._ids.clear()
            got = self._ids[key] = array("i", self.core.encode_single_piece(piece.encode())).tobytes()
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds of each text in them (len + 1)."""
        if self.find_added is None or not any(map(self.find_added.search, texts)):
            return self._encode_parts(texts)
        parts, after, first = [], [], [0]  # parts of the texts, the id after each (-1: none), each text's first part
        for t in texts:
            at = 0
            for m in self.find_added.finditer(t):
                parts.append(t[at:m.start()])
                after.append(self.added[m.group()])
                at = m.end()
            parts.append(t[at:])
            after.append(-1)
            first.append(len(parts))
        ids, bounds = self._encode_parts(parts)
        after = np.array(after, np.int32)
        real = after >= 0
        ids = np.insert(ids, bounds[1:][real], after[real])
        return ids, (bounds + np.concatenate(([0], np.cumsum(real))))[first]

    def _encode_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        starts, sizes, base, arrays = [], [], 0, []
        for t in texts:
            cps = code_points(t)
            s = pretoken_starts(cps)
            starts.append(s + base)
            sizes.append(len(s))
            arrays.append(cps)
            base += len(cps)
        at = np.concatenate(starts) if starts else np.empty(0, np.int64)
        if not len(at):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cps = np.concatenate(arrays)
        ends = np.append(at[1:], base)
        keys, first, which = np.unique(hash_runs(cps, at, ends), return_index=True, return_inverse=True)
        whole = "".join(texts)
        lo, hi = at[first].tolist(), ends[first].tolist()
        pieces = [self._known(k, whole[a:b]) for k, a, b in zip(keys.tolist(), lo, hi)]
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.int32)
        offset = np.concatenate(([0], np.cumsum(lens)[:-1]))
        n = lens[which]
        stop = np.cumsum(n)
        ids = flat[np.arange(int(stop[-1])) + np.repeat(offset[which] - (stop - n), n)]
        bounds = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(sizes)))]
        return ids, bounds

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in ids.tolist()])


def _unicode_to_byte() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies in JSON use for raw bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, or of the ``.json`` of a byte-level BPE.

    A JSON vocabulary is taken only if its merges stand in the order of the ids
    they make, since ids then are merge ranks; otherwise ValueError.
    """
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    back = _unicode_to_byte()
    raw = lambda s: bytes(back[c] for c in s)
    ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    made = [ranks[raw(a) + raw(b)] for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"])]
    if made != sorted(made):
        raise ValueError(f"{path}: merges are not in the order of their ids")
    return ranks


def read_added(path: str) -> dict[str, int]:
    """Ids of the added tokens of a ``.json`` vocabulary; a ``.tiktoken`` file has none.

    Tokens that take white space beside them or stand for whole words only, and
    those of a normalised text, are not built: ValueError.
    """
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", [])
    for t in added:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and spec.get("normalizer"):
            raise ValueError(f"{path}: added token {t['content']!r} has a rule that is not supported")
    return {t["content"]: t["id"] for t in added if t["content"]}


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary a worker process."""
    return Vocabulary(read_ranks(path), pattern, read_added(path))


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point; others stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for c in regex.findall(r"[\p{Lu}\p{Lt}]", every):
        if len(low := c.lower()) == 1:
            table[ord(c)] = ord(low)
    return table


def words(texts: list[str], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: hashes, whether letters or numbers, places in their text, lengths, and texts' first words (len + 1).

    A word is a run of letters and numbers, or a run of other signs; white space
    parts them.  ``fold``: hash the lower case.
    """
    joined = code_points("\n".join([*texts, ""]))
    kind = class_table()[joined]
    shape = np.where(kind == SPACE, 0, np.where(kind == OTHER, 2, 1)).astype(np.int8)
    edge = np.flatnonzero(shape[1:] != shape[:-1]) + 1 if len(joined) else np.empty(0, np.int64)
    start = np.concatenate(([0], edge)).astype(np.int64)
    stop = np.append(edge, len(joined)).astype(np.int64)
    real = shape[start] != 0 if len(joined) else np.zeros(len(start), bool)
    start, stop = start[real], stop[real]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))
    first = np.searchsorted(start, base)
    hashes = hash_runs(lower_table()[joined] if fold else joined, start, stop)
    own = np.repeat(base[:-1], np.diff(first))
    return hashes, shape[start] == 1, start - own, stop - start, first
