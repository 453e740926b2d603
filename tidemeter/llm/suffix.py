"""Removal of byte strings that repeat across documents, by blockwise suffix sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a
document with a smaller doc_id. Suffixes are dealt to buckets by the
smallest 16-byte hash in their first ``length`` bytes (the leftmost of equal ones),
which is a function of those bytes alone: equal strings meet in one bucket, and the
text of neighbouring suffixes is sent once, as a region. First, buckets exchange only hashes, packed
by bucket and group of documents, and tell each group which of its anchors
others have too; only the regions of those are sent. With the hashes goes how many
distinct regions an anchor has in a group. An anchor with more than HOT_REGIONS of them in all groups
is hot: its strings are dealt by a hash of the whole string instead, so that a passage
with ever new surroundings fills no bucket, be they in one group or in many. Any other
anchor sends at most HOT_REGIONS regions of 2 length - 16 bytes, about 1.4 MB.

A bucket is sorted by itself, a block of leading bytes at a time: by the first and
last 16 bytes, and where both tie, by ranks of a difference cover. The cover
holds 5 of every 16 positions so that any two positions have a common shift
below 16 into it; the sample strings there, 15 bytes shorter than ``length``, are ranked once, and one
comparison of ranks then decides a tie of any length. Memory is bounded by a bucket and
its sample, not by the corpus.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM, SEED = 50, 16, 42
#: Bytes of text in a group of documents, and in the slices that it is hashed in.
GROUP_BYTES, SLICE_BYTES = 4 << 20, 1 << 16
#: Distinct regions of an anchor, counted group by group, beyond which its strings are dealt one by one.
HOT_REGIONS = 16384
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
_powers = [pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64) | 1 for i in range(7)]
_bytes = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)


def shifts() -> np.ndarray:
    """For residues a, b the least shift that takes both into the cover."""
    return np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def anchors(raw: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, count): runs of ``count`` string starts from ``first`` on that have the same anchor.

    raw holds whole documents that end at ``ends``; no string crosses an end.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(raw) - length + 1
    if n <= 0:
        return none
    ok = np.ones(n, bool)
    for e in ends[:-1]:
        ok[max(0, e - length + 1) : e] = False
    if not ok.any():
        return none
    h = _bytes[np.frombuffer(raw, np.uint8)]
    for i in range(4):  # 2, 4, 8, 16 bytes
        h = h[: -(1 << i)] * np.uint64(_powers[i]) + h[1 << i :]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    # the place below the hash: the least key is the leftmost of the least hashes
    place = np.uint64((1 << 24) - 1)
    whole, h = h, (h & ~place) | np.arange(len(h), dtype=np.uint64)
    span, left = 1, length - GRAM + 1
    while 2 * span <= left:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if left > span:
        h = np.minimum(h[: -(left - span)], h[left - span :])
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stop = np.append(np.flatnonzero(new | ~ok), n)
    return whole[(h[first] & place).astype(np.int64)], first, stop[np.searchsorted(stop, first, side="right")] - first


class Group:
    """A group's distinct texts in order of doc_id, cut in slices, with their anchors."""

    def __init__(self, docs: pd.DataFrame, length: int, buckets: int):
        docs = docs.assign(text=[(t or "").encode() for t in docs["text"]]).sort_values(["doc_id", "text"], kind="stable")
        self.frame = docs
        self.rows = [(None if pd.isna(d) else int(d), t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)]
        self.least: dict[bytes, int] = {}
        for d, t in self.rows:
            if d is not None and len(t) >= length:
                self.least.setdefault(t, d)
        self.length, self.buckets = length, buckets
        self.slices = [*self._slices()]

    def _slices(self):
        """(raw, ends, doc_ids, hash, first, count) of each slice; a text longer than one is cut with overlaps that repeat no start."""
        held: list[tuple[int, bytes, bytes]] = []
        size = 0
        for text, d in self.least.items():
            for at in range(0, len(text) - self.length + 1, SLICE_BYTES):
                piece = text[at : at + SLICE_BYTES + self.length - 1]
                if held and size + len(piece) > SLICE_BYTES:
                    yield self._slice(held)
                    held, size = [], 0
                held.append((d, piece, text))
                size += len(piece)
        if held:
            yield self._slice(held)

    def _slice(self, held: list):
        raw = b"".join(p for _, p, _ in held)
        ends = np.cumsum([len(p) for _, p, _ in held])
        h, first, count = anchors(raw, ends, self.length)
        # the bucket, then 32 bits that tell its anchors apart
        return raw, ends, held, (h % np.uint64(self.buckets)) << np.uint64(32) | h >> np.uint64(32), first, count

    def crowds(self) -> dict[int, int]:
        """The number of distinct regions of each anchor that has several here."""
        key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s[3] for s in self.slices]]), return_counts=True)
        many = key[n > 1]
        if not len(many):
            return {}
        seen: list[tuple[int, int]] = []
        for raw, _, _, own, first, count in self.slices:
            hit = np.flatnonzero(many[np.minimum(np.searchsorted(many, own), len(many) - 1)] == own)
            ends = first[hit] + count[hit] + self.length - 1
            seen.extend(zip(own[hit].tolist(), [xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(first[hit].tolist(), ends.tolist(), strict=True)], strict=True))
        return {k: t for k, t in Counter(k for k, _ in {*seen}).items() if t > 1}

    def keys(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, its distinct anchors in this group, whether more than one run here has them), for buckets that have any."""
        key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s[3] for s in self.slices]]), return_counts=True)
        bucket, first = np.unique(key >> np.uint64(32), return_index=True)
        return [*zip(bucket.tolist(), np.split(key, first[1:]), np.split(n > 1, first[1:]), strict=True)] if len(key) else []

    def regions(self, shared: dict[int, bytes]) -> tuple[dict[int, dict], list]:
        """For each bucket its distinct regions with their number, least doc_id and anchor, for shared anchors; and the runs of each slice.

        shared maps a bucket to two bits for each of its anchors: whether other groups have it, and whether it is hot.
        """
        wanted, heat = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, key, many in self.keys():
            both = np.unpackbits(np.frombuffer(shared.get(b) or bytes(len(key) // 4 + 1), np.uint8), count=2 * len(key)).astype(bool)
            wanted.append(key[both[: len(key)] | many])
            heat.append(key[both[len(key) :]])
        want, hot = np.sort(np.concatenate(wanted)), {*np.concatenate(heat).tolist()}
        held: dict[int, dict] = {}
        runs = []
        for raw, ends, docs, key, first, count in self.slices:
            if len(want):
                hit = np.flatnonzero(want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key)
            else:
                hit = np.zeros(0, np.int64)
            own = []
            whose = np.searchsorted(ends, first[hit], side="right")
            for a, n, x, w in self._pieces(raw, first[hit].tolist(), count[hit].tolist(), key[hit].tolist(), whose.tolist(), hot):
                region, d, b = raw[a : a + n + self.length - 1], docs[w][0], x >> 32
                there = held.setdefault(b, {})
                number, least, _ = there.setdefault(region, (len(there), d, x & 0xFFFFFFFF))
                if d < least:
                    there[region] = number, d, x & 0xFFFFFFFF
                own.append((b, number, a, n, d))
            runs.append((docs, ends, own))
        return held, runs

    def _pieces(self, raw: bytes, first: list[int], count: list[int], key: list[int], whose: list[int], hot: set[int]):
        """(place, strings, key, document) of each run; a hot anchor's strings one by one, with a key of their own."""
        for a, n, x, w in zip(first, count, key, whose, strict=True):
            if x not in hot:
                yield a, n, x, w
            else:
                for i in range(a, a + n):
                    h = xxhash.xxh64_intdigest(raw[i : i + self.length], SEED)
                    yield i, 1, h % self.buckets << 32 | h >> 32, w


def recurring(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """starts without most of those whose strings of ``length`` bytes equal no other's: their hash meets no other in a table of counts. Equal strings all stay."""
    if len(starts) < 2:
        return starts[:0]
    h, whole, done = _bytes[text], None, 0
    for i in range(length.bit_length()):
        if length >> i & 1:
            # what is hashed already, then this power of two behind it
            whole = h if whole is None else whole[: len(text) - (done + (1 << i)) + 1] * np.uint64(_powers[i]) + h[done : done + len(text) - (done + (1 << i)) + 1]
            done += 1 << i
        if length >> i > 1:
            h = h[: -(1 << i)] * np.uint64(_powers[i]) + h[1 << i :]
    own = whole[starts]
    own ^= own >> np.uint64(31)
    own *= np.uint64(0xD6E8FEB86659FD93)
    # eight places a string, from the bits that mix best
    place = (own >> np.uint64(64 - (8 * len(starts)).bit_length())).astype(np.int64)
    return starts[np.bincount(place)[place] > 1]


def suffix_classes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Yield, a block of leading bytes at a time, starts whose strings of ``length`` bytes equal another's, and for each the number of its class in the block; classes are together."""
    starts = recurring(text, starts, length)
    if not len(starts):
        return
    # 16 bytes from any place on as two numbers in the order of the bytes
    eights = np.lib.stride_tricks.as_strided(text.astype(np.uint8), (len(text) - 7, 8), (1, 1))
    eight = lambda at: np.ascontiguousarray(eights[at]).view(">u8").ravel().astype(np.uint64)
    rank = np.full(len(text), -1, np.int64)
    depth = length - PERIOD + 1
    edges = np.bincount(starts, minlength=len(text) + length).astype(np.int32)
    edges -= np.bincount(starts + length, minlength=len(text) + length).astype(np.int32)
    covered = np.cumsum(edges)[: len(text)] > 0
    for c in range(PERIOD):
        if c not in COVER:
            covered[c::PERIOD] = False
    covered[max(0, len(text) - depth + 1) :] = False
    sample = np.flatnonzero(covered)
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, depth)[sample]).view(f"S{depth}").ravel()
    rank[sample] = np.unique(strings, return_inverse=True)[1]
    shift = shifts()
    lead = text[starts]
    by_lead = np.argsort(lead, kind="stable")
    for block in np.split(starts[by_lead], np.flatnonzero(np.diff(lead[by_lead])) + 1):
        keys = [eight(block + at) for at in (length - 8, length - 16, 8, 0)]
        order = np.lexsort((block, *keys))
        ties = block[order]
        new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
        while len(ties):
            # every tie against the first of its group, at the shift that takes both into the cover
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(ties)))
            pivot = np.repeat(ties[first], size)
            d = shift[pivot % PERIOD, ties % PERIOD]
            equal = (rank[ties + d] == rank[pivot + d]) | (ties == pivot)
            group = np.repeat(np.arange(len(first)), size)
            many = equal & (np.bincount(group, equal, len(first)) > 1)[group]
            if many.any():
                yield ties[many], group[many]
            ties, group = ties[~equal], group[~equal]
            new = np.append(True, group[1:] != group[:-1])[: len(ties)]


def sort_bucket(regions: list[bytes], least: list[int], anchor: list[int], length: int = LENGTH) -> list[int]:
    """For each distinct region of a bucket, as bits by string, whether the string starts in a smaller document than the region's least.

    Regions that are alone with their anchor meet nothing: equal strings have the same one.
    """
    masks = [0] * len(regions)
    times = Counter(anchor)
    own = [k for k, x in enumerate(anchor) if times[x] > 1]
    if not own:
        return masks
    text = np.frombuffer(b"".join([regions[k] for k in own]), np.uint8)
    sizes = np.array([len(regions[k]) for k in own])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(own)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(sizes) - sizes)[owner] + nth
    doc = np.array([least[k] for k in own], np.int64)
    where = np.full(len(text), -1, np.int64)
    where[starts] = np.arange(len(starts))
    bits = np.zeros(len(own), np.uint64)
    for ties, group in suffix_classes(text, starts, length):
        at = where[ties]
        d = doc[owner[at]]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        low = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.append(begin, len(d))))
        more = at[d > low]
        np.bitwise_or.at(bits, owner[more], np.uint64(1) << nth[more].astype(np.uint64))
    for k, x in zip(own, bits.tolist(), strict=True):
        masks[k] = x
    return masks


def pack_regions(held: dict) -> bytes:
    """Distinct regions in order, with their least documents and anchors."""
    lengths, rest = np.array([len(r) for r in held], "<u4"), [*held.values()]
    least, anchor = np.array([x[1] for x in rest], "<i8"), np.array([x[2] for x in rest], "<u4")
    return struct.pack("<I", len(held)) + lengths.tobytes() + least.tobytes() + anchor.tobytes() + b"".join(held)


def unpack_regions(raw: bytes) -> tuple[list[bytes], list[int], list[int]]:
    (n,) = struct.unpack_from("<I", raw)
    cut = 4 + 16 * n + np.cumsum([0, *np.frombuffer(raw, "<u4", n, 4).tolist()])
    found = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return found, np.frombuffer(raw, "<i8", n, 4 + 4 * n).tolist(), np.frombuffer(raw, "<u4", n, 4 + 12 * n).tolist()


def pack_keys(key: np.ndarray, crowds: dict[int, int]) -> bytes:
    """A bucket's anchors, and the places and numbers of those with several regions."""
    many = [(i, crowds[k]) for i, k in enumerate(key.tolist()) if k in crowds]
    return struct.pack("<I", len(key)) + (key & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + np.array(many, "<u4").tobytes()


def unpack_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, regions of each)."""
    (n,) = struct.unpack_from("<I", raw)
    many = np.frombuffer(raw, "<u4", offset=4 + 4 * n).reshape(-1, 2)
    regions = np.ones(n, np.int64)
    regions[many[:, 0]] = many[:, 1]
    return np.frombuffer(raw, "<u4", n, 4), regions


def shared_and_hot(each: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's anchors, given group by group with their regions, those of several groups, and the hot ones."""
    key, at = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
    regions = np.bincount(at, np.concatenate([r for _, r in each]), len(key))
    return key[np.bincount(at, minlength=len(key)) > 1], key[regions > HOT_REGIONS]


def _bits(values: list[int]) -> bytes:
    return np.array(values, "<u8").tobytes()


def without_repeats(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES, others: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of docs: its text's UTF-8 bytes without those that repeat a smaller document's.

    spans are the maximal removed runs, (start, end) in bytes, end exclusive; kept is what remains, as binary,
    or with ``as_text`` as a string, from which a character that is cut in two goes whole.
    Columns named in ``others`` are carried along.
    Null texts count as empty. Rows without a doc_id keep everything and remove nothing.
    Rows that share a doc_id remove nothing from each other. length is 32 to 79.
    """
    if not 2 * GRAM <= length < GRAM + 64:
        raise ValueError("length is 32 to 79")
    if {*others} & {"doc_id", "text", "g", "n_bytes", "spans", "kept"}:
        raise ValueError("a column to carry has a name of the result's")
    own = docs.select("doc_id", "text", *others)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = total // group_bytes + 1
    buckets = 64 + groups
    keyed = own.withColumn("g", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)).cast("int"))
    grouped = keyed.groupBy("g")

    def hashes(docs_: pd.DataFrame) -> pd.DataFrame:
        g = int(docs_["g"].iloc[0])
        group = Group(docs_, length, buckets)
        crowds = group.crowds()
        rows = [(b, g, pack_keys(k, crowds)) for b, k, _ in group.keys()]
        return pd.DataFrame(rows, columns=["b", "g", "data"])

    def overlap(packed: pd.DataFrame) -> pd.DataFrame:
        each = [unpack_keys(x) for x in packed["data"]]
        ours = shared_and_hot(each)
        bits = [np.packbits(np.concatenate([np.isin(x, k, assume_unique=True) for k in ours])).tobytes() if len(ours[0]) or len(ours[1]) else b"" for x, _ in each]
        return pd.DataFrame({"g": packed["g"], "b": packed["b"], "data": bits})

    def answers(packed: pd.DataFrame) -> dict[int, bytes]:
        return {int(b): x for b, x in zip(packed["b"], packed["data"], strict=True) if x}

    def regions(docs_: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs_):
            held, _ = Group(docs_, length, buckets).regions(answers(packed))
            rows = [(b, int(docs_["g"].iloc[0]), pack_regions(h)) for b, h in held.items()]
        return pd.DataFrame(rows, columns=["b", "g", "data"])

    def sort(packed: pd.DataFrame) -> pd.DataFrame:
        distinct: dict[bytes, list[int]] = {}
        each = [unpack_regions(x) for x in packed["data"]]
        for found, least, anchor in each:
            for r, d, a in zip(found, least, anchor, strict=True):
                if (x := distinct.setdefault(r, [len(distinct), d, a]))[1] > d:
                    x[1] = d
        masks = sort_bucket([*distinct], [x[1] for x in distinct.values()], [x[2] for x in distinct.values()], length)
        out = []
        for found, least, _ in each:
            own_ = [(distinct[r], d, (1 << (len(r) - length + 1)) - 1) for r, d in zip(found, least, strict=True)]
            out.append(_bits([full if low < d else masks[k] for (k, low, _), d, full in own_]))
        return pd.DataFrame({"g": packed["g"], "b": packed["b"], "data": out})

    def remove(docs_: pd.DataFrame, packed: pd.DataFrame, sorted_: pd.DataFrame) -> pd.DataFrame:
        group = Group(docs_, length, buckets)
        masks = {b: np.frombuffer(x, "<u8").tolist() for b, x in answers(sorted_).items()}
        held, runs = group.regions(answers(packed))
        least = {b: [x[1] for x in h.values()] for b, h in held.items()}
        gone: dict[bytes, list[tuple[int, int]]] = {}
        seen: dict[bytes, int] = {}
        for docs_in, ends, own_ in runs:
            flag = np.zeros(int(ends[-1]) + 1, np.int32)
            for b, number, a, n, d in own_:
                mask = (1 << n) - 1 if least[b][number] < d else masks[b][number]
                if mask == (1 << n) - 1:
                    flag[a] += 1
                    flag[a + n + length - 1] -= 1
                else:
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        flag[a + low] += 1
                        flag[a + low + length] -= 1
                        mask &= mask - 1
            covered = (np.cumsum(flag[:-1]) > 0).astype(np.int8)
            for k, (_, piece, text) in enumerate(docs_in):
                base = int(ends[k]) - len(piece)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[base : int(ends[k])], [0]]))).reshape(-1, 2) + seen.get(text, 0)
                gone.setdefault(text, []).extend(map(tuple, edge.tolist()))
                seen[text] = seen.get(text, 0) + SLICE_BYTES
        rows = []
        for d, text in group.rows:
            spans: list[tuple[int, int]] = []
            if d is not None and len(text) >= length:
                for a, b in [(0, len(text))] if group.least[text] < d else sorted(gone.get(text, [])):
                    if spans and a <= spans[-1][1]:
                        spans[-1] = spans[-1][0], max(b, spans[-1][1])
                    else:
                        spans.append((a, b))
            kept = b"".join(text[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(text)], strict=True))
            rows.append((d, len(text), [{"start": a, "end": b} for a, b in spans], kept.decode("utf-8", "ignore") if as_text else kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"), **{c: group.frame[c].to_numpy() for c in others})

    blob = "b int, g int, data binary"
    told = grouped.applyInPandas(hashes, blob).groupBy("b").applyInPandas(overlap, "g int, b int, data binary")
    sent = grouped.cogroup(told.groupBy("g")).applyInPandas(regions, blob)
    sorted_ = sent.groupBy("b").applyInPandas(sort, "g int, b int, data binary")
    back = told.withColumn("kind", F.lit(0)).unionByName(sorted_.withColumn("kind", F.lit(1)))

    def last(docs_: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        if not len(docs_):
            return pd.DataFrame(columns=["doc_id", "n_bytes", "spans", "kept", *others])
        return remove(docs_, packed[packed["kind"] == 0], packed[packed["kind"] == 1])

    kinds = dict(own.dtypes)
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept " + ("string" if as_text else "binary") + "".join(f", `{c}` {kinds[c]}" for c in others)
    return grouped.cogroup(back.groupBy("g")).applyInPandas(last, schema)
