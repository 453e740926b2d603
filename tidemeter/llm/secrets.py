"""Secret scans by assignment-aware lexing.

Besides the base patterns, a text that names something sensitive is lexed as
source or configuration: names with quoted or bare literals after ``=``, ``:``, ``:=``
or ``=>``, quoted keys, element contents, and sums of literals and names.
Constants are propagated, so a literal that reaches a password through another
name is found where it is written. A literal counts if its target's name is
sensitive and it looks like a value rather than a placeholder.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_batches

#: In this order at equal starts.
KINDS = ("assign", "access", "hex", "literal")
#: Fixed by the contract.
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]+")
_stems = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Sensitivity of a word in a target's name, and words that mean it is about a secret rather than one.
WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "secret": 1.0, "pwd": 0.9, "apikey": 0.9, "credential": 0.9, "credentials": 0.9, "token": 0.9, "pass": 0.8, "auth": 0.6, "authorization": 0.8}
QUALIFIERS = {"api", "access", "private", "signing", "encryption", "master", "account", "session"}
ABOUT = {"path", "file", "url", "uri", "name", "length", "count", "type", "hint", "policy", "enabled", "expiry", "expires", "ttl", "field", "label", "limit", "min", "max", "prompt", "help", "regex", "header", "endpoint", "id"}
PLACEHOLDERS = re.compile(r"^(x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\}|null|none|true|false|todo|undefined)$|change.?me|example|placeholder|your[_-]|dummy|redacted", re.I)
#: The part of PLACEHOLDERS that holds anywhere in a value.
_inner = re.compile(r"change.?me|example|placeholder|your[_-]|dummy|redacted", re.I)
_inner_start = re.compile(rf"(?={_inner.pattern})", re.I)
#: In the letters alone of a text (lower case) one of these stands if a name in it is sensitive.
_roots = tuple(w.encode() for w in ("key", *WEIGHTS))
_others = bytes(i for i in range(256) if not 97 <= i <= 122)
_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Or a name that no value follows: taken whole, as nothing that begins within it is a pair either, and a long run of letters is read once.
_pair = re.compile(r"""(["']?)([A-Za-z_$][\w.$-]*+)\1[ \t]*+(?:\[[^\[\]\n]*+\])?[ \t]*+(?::[ \t]*+[A-Za-z_][\w.<>\[\]]*[ \t]*(?==))?(?::=|=>|[=:])(?!=)[ \t]*+|[A-Za-z_$][\w.$-]*+""")
_element = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]++)</\1>")
#: A literal without quotes, to its end; pairs that begin within it are measured by one Run.
_bare = re.compile(r"""[^\s,;"'(){}\[\]<>]++""")
_name = re.compile(r"[A-Za-z_$][\w.$-]*$")
_inside = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by kind."""
    low, out = text.lower(), []
    if any(s in low for s in _stems):
        out += [(m.start(), "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _access.finditer(text) if len(m[0]) >= 16]
    if _long_hex(text):
        out += [(m.start(), "hex", m.end()) for m in _hex.finditer(text) if len(m[0]) >= 32]
    return out


def _long_hex(text: str) -> bool:
    """Whether 32 hex digits may stand in a row: such a run holds every 32nd place and 16 more on one side of it."""
    hexes = "0123456789abcdef"
    for m in re.finditer("[0-9a-f]", text[31::32]):
        i = 31 + 32 * m.start()
        if not text[i - 15 : i + 1].strip(hexes) or not text[i : i + 16].strip(hexes):
            return True
    return False


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _words.findall(name)]
    joined = set(words) | {a + b for a, b in zip(words, words[1:], strict=False)}
    weight = max((WEIGHTS.get(w, 0.0) for w in joined), default=0.0)
    if "key" in joined and joined & QUALIFIERS:
        weight = max(weight, 0.9)
    return weight * (0.3 if words and words[-1] in ABOUT else 1.0)


def of_words(name: str) -> bool:
    """Whether a name means a secret that is written as words with spaces."""
    words = [w.lower() for w in _words.findall(name)]
    return bool({"passphrase", "mnemonic"} & {*words} or any(p == ("pass", "phrase") for p in zip(words, words[1:], strict=False)))


KIND_SIGNS = ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")


def mixed(entropy: float, kinds: int) -> float:
    return min(1.0, entropy / 4) * (0.5 if kinds == 1 else 0.8 if kinds == 2 else 1.0)


def strength(value: str | Value, spaced: bool = False) -> float:
    """0 to 1: long values of mixed signs score high, words, placeholders and sentences low. spaced: words with spaces may be the secret."""
    value = value if isinstance(value, Value) else Value(value)
    if value.n < 8 or (value.spaced and not spaced) or value.placeholder():
        return 0.0
    if value.known is not None:
        return value.known
    counts = value.counts()
    entropy = -sum(k / value.n * log2(k / value.n) for k in counts.values() if k)
    return mixed(entropy, sum(any(re.match(p, c) for c in counts) for p in KIND_SIGNS))


class Run:
    """A bare literal from ``at`` to ``end`` whose suffixes are values of the pairs that begin within it.

    Suffixes are asked for from left to right; what stands before one leaves the
    counts, so that a chain of pairs of any length is read twice and never once a pair.
    """

    BLOCK = 4096

    def __init__(self, text: str, at: int, end: int):
        self.text, self.begin, self.at, self.end = text, at, at, end
        self.left = Counter(text[at:end])
        self.sum = sum(k * log2(k) for k in self.left.values())
        self.kinds = [0] * len(KIND_SIGNS)
        for c, k in self.left.items():
            self.kinds[_kind(c)] += k
        self.joint = max(text.rfind("=", at, end), text.rfind(":", at, end))
        self.words = max((m.start() for m in _inner_start.finditer(text, at, end)), default=-1)
        self.blocks: list[Counter] | None = None

    def name(self, at: int) -> str | None:
        """The suffix where it may be a name: no pair begins within it."""
        return self.text[at : self.end] if at > self.joint else None

    def value(self, at: int) -> Value:
        for c in self.text[self.at : at]:
            k = self.left[c]
            self.sum += ((k - 1) * log2(k - 1) if k > 1 else 0.0) - k * log2(k)
            self.kinds[_kind(c)] -= 1
            if k > 1:
                self.left[c] = k - 1
            else:
                del self.left[c]
        self.at = at
        n = self.end - at
        out = Value("", ((at, self.end),))
        out.n, out.text, out.run = n, None, (self, at)
        out.head, out.tail, out.found = self.text[at : at + EDGE], self.text[max(at, self.end - EDGE) : self.end], self.words >= at
        out.signs = frozenset(self.left) if len(self.left) <= 2 else None
        out.known = mixed(max(0.0, log2(n) - self.sum / n), sum(k > 0 for k in self.kinds))
        return out

    def counts(self, at: int) -> Counter:
        """Signs from ``at`` on, from those of whole blocks."""
        first = (at // self.BLOCK + 1) * self.BLOCK
        if first >= self.end:
            return Counter(self.text[at : self.end])
        if self.blocks is None:
            self.blocks, total = [], Counter()
            for k in range((self.end - 1) // self.BLOCK, self.begin // self.BLOCK - 1, -1):
                total.update(self.text[max(self.begin, k * self.BLOCK) : min(self.end, (k + 1) * self.BLOCK)])
                self.blocks.append(total.copy())
            self.blocks.reverse()
        return self.blocks[first // self.BLOCK - self.begin // self.BLOCK] + Counter(self.text[at:first])


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


#: Longer values are kept as what strength() asks of them, as sums of names may double with each line.
WHOLE, EDGE = 4096, 64


class Value:
    """A value and the literals that it is made of, as its own spans and references to the values in it."""

    def __init__(self, text: str, spans: tuple = ()):
        self.n, self.text, self.spans, self.parts = len(text), text, spans, ()
        self.spaced = any(c.isspace() for c in text)
        self.head, self.tail, self.found, self.letters = text[:EDGE], text[-EDGE:], False, None
        self.run, self.known, self.signs = None, None, None
        if self.n > WHOLE:
            self.letters, self.found, self.text = Counter(text), bool(_inner.search(text)), None

    @classmethod
    def of(cls, parts: list[Value], spans: tuple = ()) -> Value:
        """The parts one after the other."""
        if len(parts) == 1 and not spans:
            return parts[0]
        out, n = cls("", spans), sum(p.n for p in parts)
        if n <= WHOLE:
            out = cls("".join(p.whole() for p in parts), spans)
        else:
            out.n, out.text, out.letters = n, None, Counter()
            out.spaced = any(p.spaced for p in parts)
            for p in parts:
                out.letters.update(p.counts())
                # what a part alone is need not be what the sum is, but words within it stay
                out.found = out.found or p.inside() or bool(_inner.search(out.tail + p.head))
                out.head = (out.head + p.head)[:EDGE]
                out.tail = (out.tail + p.tail)[-EDGE:]
        out.parts = tuple(parts)
        return out

    def whole(self) -> str:
        return self.run[0].text[self.run[1] : self.run[0].end] if self.run else self.text

    def counts(self) -> Counter:
        if self.letters is None and self.run:
            run, at = self.run
            self.letters = run.counts(at)
        return Counter(self.text) if self.text is not None else self.letters

    def inside(self) -> bool:
        return bool(_inner.search(self.text)) if self.text is not None else self.found

    def placeholder(self) -> bool:
        if self.text is not None:
            return bool(PLACEHOLDERS.search(self.text))
        # a value without white space: the forms that hold for a whole value show at its ends and in its signs
        # a Run says which signs there are if they are few
        signs = (self.signs or {"x", "y", "z"}) if self.run else set(self.letters)
        ends = any(self.head.startswith(a) and self.tail.endswith(b) for a, b in (("<", ">"), ("${", "}"), ("%(", ")s"), ("{{", "}}")))
        return self.found or ends or signs <= {"x", "X"} or signs == {"*"} or signs == {"."}

    def literals(self, seen: set[int]) -> Iterator[tuple[int, int]]:
        """Spans of this value and of those in it that are not in seen."""
        todo = [self]
        while todo:
            v = todo.pop()
            if id(v) not in seen:
                seen.add(id(v))
                yield from v.spans
                todo += v.parts


def _named(name: str, known: dict[str, Value]) -> Value | None:
    return known.get(name) or (known.get(name.strip("${}")) if name[:1] == "$" else None)


def _expression(text: str, at: int, known: dict[str, Value], runs: list[Run]) -> Value | None:
    """Value of the sum of literals and names at ``at``. runs holds the bare literal read last: a pair that begins within it has the rest of it alone."""
    if runs and runs[0].begin < at < runs[0].end:
        name = runs[0].name(at)
        return (_named(name, known) if name else None) or runs[0].value(at)
    parts: list[Value] = []
    while True:
        quote = text[at : at + 1]
        if quote in ("'", '"', "`") and quote:
            stop = at + 1
            while stop < len(text) and text[stop] not in (quote, "\n"):
                stop += 2 if text[stop] == "\\" else 1
            if text[stop : stop + 1] != quote:
                break
            begin, inner = at + 1, []
            for m in _inside.finditer(text, at + 1, stop):
                if got := known.get(m[1] or m[2]):
                    inner += [Value(text[begin : m.start()]), got]
                    begin = m.end()
            parts.append(Value.of([*inner, Value(text[begin:stop])], ((at + 1, stop),)))
            at = stop + 1
        elif m := _bare.match(text, at):
            if got := _named(m[0], known):
                parts.append(got)
            elif not parts:
                runs[:] = [Run(text, *m.span())]
                parts.append(runs[0].value(at))
            else:
                break
            at = m.end()
        while text[at : at + 1] in (" ", "\t") and at < len(text):
            at += 1
        if text[at : at + 1] != "+":
            break
        at += 1
        while text[at : at + 1] in (" ", "\t") and at < len(text):
            at += 1
    return Value.of(parts) if parts else None


def pairs(text: str) -> list[tuple[str, Value]]:
    """(name, value) of every assignment, constants propagated in text order."""
    known: dict[str, Value] = {}
    runs: list[Run] = []
    out = []
    for m in _pair.finditer(text):
        if m[2] and (got := _expression(text, m.end(), known, runs)):
            out.append((m[2], got))
            if _name.match(m[2]):
                known[m[2]] = got
    out += [(m[1], Value(m[2].strip(), (m.span(2),))) for m in _element.finditer(text)]
    return out


def may_name(text: str) -> bool:
    """Whether a name in text may be sensitive: its words are letters that follow one another but for other signs."""
    letters = text.encode("utf-8", "surrogatepass").lower().translate(None, _others)
    return any(r in letters for r in _roots)


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, end exclusive, by start and then kind; null counts as empty.

    Literals inside a base span add nothing.
    """
    text = text or ""
    out = base_spans(text)
    if may_name(text):
        base = sorted((a, b) for a, _, b in out)
        more, seen = set(), set()
        # the furthest end of a base span that begins by then
        begins = [a for a, _ in base]
        reach = [*accumulate((b for _, b in base), max)]
        for name, value in pairs(text):
            if (weight := sensitivity(name)) and weight * strength(value, of_words(name)) >= 0.5:
                more |= {(a, b) for a, b in value.literals(seen) if b > a and not ((k := bisect_right(begins, a)) and reach[k - 1] >= b)}
        out += [(a, "literal", b) for a, b in more]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with ``secret_spans``, an array of (kind, start, end) over the whole text; every row and column kept.

    Null and empty texts have no spans, repeated rows stay repeated, an older
    secret_spans is replaced. Long texts, chains of pairs and bare literals of any length are read whole, in time in proportion to them.
    """
    docs = docs.drop("secret_spans")
    fields = [f.name for f in docs.schema.fields]
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = [[{"kind": k, "start": a, "end": b} for a, k, b in scan(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], [*fields, "secret_spans"])

    return in_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("secret_spans", kind)]))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """(doc_id, ...) as docs, each run of secret spans in text replaced by ``mark``; null texts stay null, repeated rows repeated.

    A bare literal goes whole, however long and whatever pairs begin within it.
    """
    fields = [f.name for f in docs.schema.fields]
    at = fields.index("text")

    def clean(text: str | None) -> str | None:
        spans = scan(text)
        if not spans:
            return text
        out, done = [], 0
        for a, _, b in spans:
            if b > done:
                if a >= done:
                    out += [text[done:a], mark]
                done = b
        return "".join(out) + text[done:]

    def run(batches):
        for batch in batches:
            columns = [*batch.columns]
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, fields)

    return in_batches(docs).mapInArrow(run, docs.schema)


