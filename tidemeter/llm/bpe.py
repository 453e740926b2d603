"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word, merging leaves exactly one last token. A suffix automaton
of the vocabulary lists the tokens that end at each place; a token is the last
one of a prefix if the prefix before it ends in a token that is compatible with
it: undoing the merges of both at their common border meets no merge that BPE
would have made across it earlier. The winners are kept as back-pointers, and
following them from the end gives the ids that merging gives.

Reads a tokenizer file of this kind: NFC, white space to a space, lower case; a
split pattern; byte-level symbols with an end-of-word suffix; merges; no decoder.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Known, in_batches, rows_of

#: Bytes of words, and of chunks, that a worker remembers; later ones are encoded each time.
CACHE_BYTES = 48 << 20
#: Token pairs whose compatibility a worker remembers.
PAIRS = 400_000
_space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Stands for the end-of-word suffix, outside the byte-level alphabet.
_END = "\ue000"


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class SuffixAutomaton:
    """The substrings of all vocabulary tokens, one state for those that end at the same places.

    Built over the tokens' trie, level by level. A token is the longest string of
    its state, as nothing stands before it where it was put in; so the tokens
    that end at a place of a text are the state reached there, if it is matched
    whole, and the states its suffix links lead to.
    """

    def __init__(self, tokens: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.long = [-1], [0]
        token: dict[int, int] = {}
        level = [("", 0, [*tokens])]
        while level:
            deeper = []
            for prefix, state, own in level:
                by: dict[str, list[str]] = {}
                for t in own:
                    if len(t) == len(prefix):
                        token[state] = tokens[t]
                    else:
                        by.setdefault(t[len(prefix)], []).append(t)
                deeper += [(prefix + c, self._extend(state, c), ts) for c, ts in by.items()]
            level = deeper
        # of each state the token that is its whole, and the next state up the links with a token
        self.token = [token.get(s, -1) for s in range(len(self.long))]
        self.up = [0] * len(self.long)
        for s in sorted(range(1, len(self.long)), key=self.long.__getitem__):
            p = self.link[s]
            self.up[s] = p if self.token[p] >= 0 else self.up[p]

    def _state(self, long: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.long.append(long)
        self.link.append(link)
        return len(self.long) - 1

    def _extend(self, last: int, c: str) -> int:
        """The state of the string that c makes of last's longest."""
        follow, link, long = self.next, self.link, self.long
        if (q := follow[last].get(c)) is not None:
            return q if long[q] == long[last] + 1 else self._split(last, c, q)
        new, p = self._state(long[last] + 1, {}, 0), last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            link[new] = q if long[q] == long[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: str, q: int) -> int:
        """A state of its own for the strings of q up to one longer than p's longest."""
        new = self._state(self.long[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def matches(self, text: str):
        """(place of the last letter, length, token) of every token in text, by place and then longest first."""
        follow, link, long, token, up = self.next, self.link, self.long, self.token, self.up
        s = n = 0
        for i, c in enumerate(text):
            while s and c not in follow[s]:
                s = link[s]
                n = long[s]
            if c not in follow[s]:
                continue
            s, n = follow[s][c], n + 1
            at = s if n == long[s] and token[s] >= 0 else up[s]
            while at:
                yield i, long[at], token[at]
                at = up[at]


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["unk_token"]:
            raise ValueError("another kind of tokenizer file")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, (a, b) in enumerate(model["merges"]):
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((a, b), k)
            if t not in self.halves:
                self.halves[t], self.made[t] = (a, b), k
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = SuffixAutomaton({name.removesuffix(suffix) + _END if name.endswith(suffix) else name: i for name, i in vocab.items()})
        self.symbols = byte_symbols()
        self.known, self.words = Known(CACHE_BYTES), Known(CACHE_BYTES)

    def _across(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge earlier than ``limit`` joins the two across their border."""
        rank, halves, made = self.rank, self.halves, self.made
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            # undo the later of the two; what it was made of was there before that merge
            if a > b:
                limit, left = min(limit, a), halves[left][1]
            else:
                # an equal merge further left comes first, so only an earlier or equal one here counts
                limit, right = min(limit, b + 1), halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        if pair not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[pair] = self._across(left, right, float("inf"))
        return self.pairs[pair]

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        if token not in self.whole:
            h = self.halves.get(token)
            self.whole[token] = h is None or (self.reachable(h[0]) and self.reachable(h[1]) and self._across(*h, self.made[token]))
        return self.whole[token]

    def word(self, symbols: str) -> list[int]:
        """Ids of one word of byte-level symbols."""
        text = symbols[:-1] + symbols[-1] + _END
        n = len(symbols)
        last: list[int] = [-1] * (n + 1)
        size = [0] * (n + 1)
        for stop, length, token in self.automaton.matches(text):
            # the suffix and the symbol before it are one place
            end = stop if text[stop] == _END else stop + 1
            begin = stop + 1 - length
            if end == n and text[stop] != _END:
                continue
            if last[end] < 0 and (begin == 0 or last[begin] >= 0) and self.reachable(token) and (begin == 0 or self.compatible(last[begin], token)):
                last[end], size[end] = token, end - begin
        ids, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no tokens for {symbols!r}")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def chunk(self, text: str) -> bytes:
        """Ids of a normalized text without white space, as little-endian unsigned 32-bit integers."""
        symbols, ids = self.symbols, b""
        for w in self.split.findall(text):
            own = self.words.get(w)
            if own is None:
                own = np.array(self.word("".join([symbols[b] for b in w.encode()])), "<u4").tobytes()
                self.words.keep(w, own)
            ids += own
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; the special tokens' strings give their ids, as in the library."""
        known, out = self.known, []
        for part in self._special.split(text) if self._special and "<|" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            # lower() gives a final sigma its own form; the library lowers letter by letter
            chunks = _space.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower().split(" ")
            got = [*map(known.get, chunks)]
            if None in got:
                for k, g in enumerate(got):
                    if g is None:
                        got[k] = self.chunk(chunks[k])
                        known.keep(chunks[k], got[k])
            out += got
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' names, a space between them: the file names no decoder."""
        return " ".join([*map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())])


def bpe(path: str) -> PrefixBpe:
    """One encoder a worker process and tokenizer file."""
    if path not in _held:
        _held[path] = PrefixBpe(path)
    return _held[path]


_held: dict[str, PrefixBpe] = {}


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs: whole texts, null as empty; ids as little-endian 32-bit integers."""

    def run(batches):
        model = bpe(tokenizer)
        for docs_, texts in rows_of(batches, "doc_id", "text"):
            for k in range(0, len(texts), 256):
                ids = [model.encode(t or "") for t in texts[k : k + 256]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_[k : k + 256], pa.int64()), pa.array(ids, pa.binary()), pa.array([model.decode(i) for i in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
