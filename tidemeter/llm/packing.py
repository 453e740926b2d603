"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Pieces are at most as long as a sequence, so the instance is its histogram: one
count for each length, a bounded table however many documents there are. The
reduction takes the longest length, finds a set with it that dominates every
other set it could share a sequence with, and fixes as many such sets as there
are; best-fit decreasing packs what is left, again many equal sequences at a
time. The result is a short list of patterns. Pieces then learn their place from
their rank among the pieces of their length, counted in salted parts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, rows_of
from .tokens import encoder

CAPACITY = 2048
#: Pieces of one length that are ranked together, about: a length has as many parts as that takes.
PART_PIECES = 1 << 16


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: one, or full ones after a first that may be shorter."""
    if not n:
        return []
    first = n % capacity or capacity
    stops = [*range(first, n + 1, capacity)]
    return [*zip([0, *stops], stops, strict=False)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): whole documents' ids and an end id; longer ones than ``capacity`` are cut so that all pieces but the first are full.

    ids are little-endian unsigned 32-bit integers. Null texts count as empty and have the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for docs_, texts in rows_of(batches, "doc_id", "text"):
            for k in range(0, len(texts), 256):
                out = []
                for d, raw in zip(docs_[k : k + 256], encode([t or "" for t in texts[k : k + 256]]), strict=True):
                    raw += end
                    out += [(d, i, a, b - a, raw[4 * a : 4 * b]) for i, (a, b) in enumerate(cuts(len(raw) // 4, capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class _Left:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.count)

    def take(self, pattern: list[int], times: int) -> None:
        for s in pattern:
            self.count[s] -= times
            if not self.count[s]:
                del self.count[s]
                self.sizes.remove(s)

    def upto(self, room: int, without: list[int]) -> int | None:
        """The longest length of at most ``room`` that is left after ``without`` is taken."""
        k = bisect_right(self.sizes, room) - 1
        while k >= 0 and self.count[self.sizes[k]] <= without.count(self.sizes[k]):
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def times(self, pattern: list[int]) -> int:
        return min(self.count[s] // pattern.count(s) for s in set(pattern))


def reduce_dominated(left: _Left, capacity: int) -> list[tuple[list[int], int]]:
    """Fix the sets that dominate every other set of their longest piece, for each length as the longest.

    A set dominates another if each of its pieces can take the place of a group
    of the other's pieces at least as short in sum. With longest piece j and k
    the longest that fits beside it: {j} when nothing fits; {j, k} when k fills
    the sequence, when no two pieces fit, or when at most two fit and no pair is
    longer than k; {j, k, b} with b the longest beside both, when at most two
    fit and no pair holds two pieces longer than b.
    """
    fixed = []
    for j in sorted(left.sizes, reverse=True):
        while left.count.get(j):
            room = capacity - j
            k = left.upto(room, [j])
            pattern = [j] if k is None else [j, k]
            if k is not None and k < room:
                small = _shortest(left, j)
                if len(small) >= 2 and sum(small[:2]) <= room:
                    if len(small) > 2 and sum(small) <= room:
                        break
                    b = left.upto(room - k, [j, k])
                    half = left.upto(room // 2, [j]) or 0
                    if b is not None and half <= b:
                        pattern = [j, k, b]
                    elif _longest_pair(left, j, room) > k:
                        break
            n = left.times(pattern)
            fixed.append((pattern, n))
            left.take(pattern, n)
    return fixed


def _shortest(left: _Left, j: int) -> list[int]:
    """The three shortest pieces beside one of length j."""
    out: list[int] = []
    for s in left.sizes:
        out += [s] * min(3 - len(out), left.count[s] - (s == j))
        if len(out) == 3:
            break
    return out


def _longest_pair(left: _Left, j: int, room: int) -> int:
    best = 0
    for a in left.sizes:
        if 2 * a > room:
            break
        b = left.upto(room - a, [j, a])
        best = max(best, a + b if b is not None and left.count[a] > (a == j) else 0)
    return best


def best_fit(left: _Left, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing: each piece, longest first, goes into the fullest open sequence that takes it, or opens one.

    A sequence that takes a piece is fuller than before, so the next piece of that
    length goes there too while it fits: equal sequences fill together.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((pattern, n))

    for size in reversed(left.sizes):
        n = left.count[size]
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                add(capacity - each * size, (size,) * each, n // each)
                add(capacity - n % each * size, (size,) * (n % each), 1 if n % each else 0)
                break
            room = rooms[k]
            pattern, there = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[k]
            each = min(room // size, n)
            some = min(there, n // each)
            add(room, pattern, there - some)
            add(room - each * size, pattern + (size,) * each, some)
            n -= each * some
    return [([*p], n) for own in open_.values() for p, n in own]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, number of sequences) that use every piece once."""
    left = _Left(counts)
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces a sequence, first sequence, offset of its first piece), by rank."""
    seen: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for pattern, n in patterns:
        pattern = sorted(pattern, reverse=True)
        for s in dict.fromkeys(pattern):
            m = pattern.count(s)
            out.setdefault(s, []).append((seen.get(s, 0), m, first, sum(x for x in pattern if x > s)))
            seen[s] = seen.get(s, 0) + m * n
        first += n
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset (long): no sequence is longer than ``capacity``, offsets are gapless from 0.

    pieces has doc_id, piece, start and a length of 1 to ``capacity``, and may have a digest
    ``ids_crc32`` that tells rows with the same numbers apart; other columns are
    kept. Only the histogram, at most ``capacity`` rows, reaches the driver.
    """
    for name in ("sequence_id", "offset", "_salt", "_salts", "_rank", "_before"):
        pieces = pieces.drop(name)
    each = cut(pieces.groupBy("length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in each.collect()}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    table = places(plan(counts, capacity))
    salts = F.broadcast(each.select("length", F.ceil(F.col("n") / PART_PIECES).alias("_salts")))  # at most ``capacity`` rows
    salted = pieces.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts"))).select(*pieces.columns, "_salt")
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = parts.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_rank", own).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        s, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        for size in np.unique(s):
            own = np.flatnonzero(s == size)
            rows = table[int(size)]
            low, m, first, at = rows[np.searchsorted(rows[:, 0], r[own], side="right") - 1].T
            d = r[own] - low
            seq[own], off[own] = first + d // m, at + d % m * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.withColumn("_p", place("length", "_rank"))
    return placed.select(*pieces.columns, "_p.sequence_id", "_p.offset")
