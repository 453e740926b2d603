"""Token ids of whole texts, and a binary file format for them.

A segment file holds the ids of consecutive documents end to end, with the
document boundaries (and the ascending document ids) as Elias-Fano sequences:
each value's low bits packed, its high bits as a unary bit map of at most three
bits a value, and the place of every 256th one for select. No 64-bit offset
table is stored. Segments are rows of a Parquet table, so Spark's committer
writes them and a lost executor leaves no half-written file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import Known, in_batches, rows_of, shared_folder, width

MAGIC = b"EFTK1\0"
SAMPLE = 256
#: Ids in a segment at most, but for a single longer document.
SEGMENT_IDS = 1 << 20
#: Bytes of words, and of parts of words, that a worker remembers; later ones are encoded each time.
WORD_BYTES, PART_BYTES = 64 << 20, 16 << 20
#: A space after white space: such texts are cut at other spaces only.
_loose = re.compile(r"\s ")
_cut = re.compile(r"(?<=\S) ")
#: Fixed by the tokenizer: its split pattern, and its letters for bytes.
_pretoken = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_bytes = dict(enumerate(byte_symbols()))


class Encoder:
    """The tokenizers library's ids, with words remembered.

    Byte-level BPE never joins what stands before a space that follows a
    non-space with what comes after it, so a text is encoded word by word and
    each distinct word goes through the library once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known, self.parts = Known(WORD_BYTES), Known(PART_BYTES)
        self.tokenize = self.tokenizer.model.tokenize

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, pretoken: str) -> bytes:
        letters = pretoken.encode().decode("latin-1").translate(_bytes)
        return b"".join([struct.pack("<I", t.id) for t in self.tokenize(letters)])

    def _part(self, pretoken: str) -> bytes:
        """Ids of a pretoken; of a plain word after a space, those that the word is known by."""
        held, key = (self.known, pretoken[1:]) if pretoken[0] == " " and pretoken[1:].isalpha() else (self.parts, pretoken)
        got = held.get(key)
        if got is None:
            got = self._model(pretoken)
            held.keep(key, got)
        return got

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word with a space before it. Plain Latin words go to the library's BPE model in pretokens, all others to its whole pipeline."""
        out, other, part, model = {}, [], self._part, self._model
        for w in words:
            if not w or max(w) >= "\u0250" or "<|" in w:
                other.append(w)
            elif w.isalpha():
                out[w] = model(" " + w)
            elif w[-1] in ".,!?" and w[:-1].isalpha():
                out[w] = part(" " + w[:-1]) + part(w[-1])
            else:
                out[w] = b"".join([part(p) for p in _pretoken.findall(" " + w)])
        if other:
            out |= zip(other, self._library([" " + w for w in other]), strict=True)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        known = self.known
        words = [_cut.split(t) if _loose.search(t) else t.split(" ") for t in texts]
        found = [[*map(known.get, w[1:])] for w in words]
        new = [*dict.fromkeys(w for ws, got in zip(words, found, strict=True) if None in got for w, g in zip(ws[1:], got, strict=True) if g is None)]
        fresh = self._words(new) if new else {}
        for w, got in fresh.items():
            known.keep(w, got)
        out = []
        for ws, got, first in zip(words, found, self._library([w[0] for w in words]), strict=True):
            if None in got:
                got = [fresh[w] if g is None else g for w, g in zip(ws[1:], got, strict=True)]
            out.append(first + b"".join(got))
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_encoders: dict[str, Encoder] = {}


def elias_fano(values: np.ndarray) -> bytes:
    """Non-decreasing non-negative integers as count, universe, low-bit width, select samples, low bits, high bits."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    v = values.astype(np.uint64)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(at[-1]) + 1) if n else 0, np.uint8)
    high[at] = 1
    samples = at[::SAMPLE].astype("<u4")
    parts = samples.tobytes(), np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    return struct.pack("<QQB3I", n, top, low, *map(len, parts)) + b"".join(parts)


class EliasFano:
    """Reads what elias_fano() wrote, at ``at`` of ``raw``; ``end`` is where it ends."""

    def __init__(self, raw: bytes, at: int = 0):
        self.n, self.top, self.low, a, b, c = struct.unpack_from("<QQB3I", raw, at)
        at += struct.calcsize("<QQB3I")
        self.samples = np.frombuffer(raw, "<u4", a // 4, at)
        self.lows = np.frombuffer(raw, np.uint8, b, at + a)
        self.highs = np.frombuffer(raw, np.uint8, c, at + a + b)
        self.end = at + a + b + c

    def between(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: select from the sample before a to the one behind b, reading no more of the bit maps than lies there."""
        if not 0 <= a <= b <= self.n:
            raise IndexError(a, b)
        if a == b:
            return np.zeros(0, np.int64)
        k, m = a // SAMPLE, -(-b // SAMPLE)
        start, stop = int(self.samples[k]), int(self.samples[m]) if m < len(self.samples) else 8 * len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[start // 8 : -(-stop // 8)], bitorder="little")) + start // 8 * 8
        ones = ones[np.searchsorted(ones, start) :][a - k * SAMPLE : b - k * SAMPLE]
        high = (ones - np.arange(a, b)).astype(np.int64) << self.low
        first = a * self.low // 8
        bits = np.unpackbits(self.lows[first : -(-b * self.low // 8)], bitorder="little")[a * self.low - 8 * first :][: (b - a) * self.low]
        return high + (bits.reshape(b - a, self.low).astype(np.int64) << np.arange(self.low)).sum(axis=1, dtype=np.int64)

    def select(self, i: int) -> int:
        """Value i: from the nearest sample, count ones by byte, then by bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = divmod(at, 8)
        seen = -((self.highs[byte] & ((1 << skip) - 1)).bit_count())
        while seen + int(self.highs[byte]).bit_count() <= left:
            seen += int(self.highs[byte]).bit_count()
            byte += 1
        for bit in range(8):
            if self.highs[byte] >> bit & 1:
                if seen == left:
                    break
                seen += 1
        value = (byte * 8 + bit - i) << self.low
        for k in range(self.low):
            j = i * self.low + k
            value |= int(self.lows[j // 8] >> (j % 8) & 1) << k
        return value


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A segment of documents in ascending order of id, those without one first."""
    none = sum(d is None for d in doc_ids)
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(named[0]) if len(named) else 0
    stops = np.cumsum([len(x) // 4 for x in ids])
    flat = np.frombuffer(b"".join(ids), "<u4")
    small = not len(flat) or int(flat.max()) < 1 << 16
    body = flat.astype("<u2" if small else "<u4").tobytes()
    keys = elias_fano((named - base).astype(np.uint64))
    head = MAGIC + struct.pack("<BIqQ", 2 if small else 4, none, base, len(flat))
    data = head + keys + elias_fano(stops.astype(np.uint64)) + body
    return data + struct.pack("<I", zlib.crc32(data))


class Segment:
    """A segment's documents; ids and offsets of some come by select, no table of all is made."""

    def __init__(self, none: int, base: int, keys: EliasFano, ends: EliasFano, ids: np.ndarray):
        self.none, self.base, self.keys, self.ends, self.ids = none, base, keys, ends, ids

    def __len__(self) -> int:
        return self.ends.n

    def documents(self, a: int, b: int) -> list[int | None]:
        """Document ids a to b - 1."""
        named = self.keys.between(max(0, a - self.none), max(0, b - self.none)) + self.base
        return [None] * (min(b, self.none) - min(a, self.none)) + named.tolist()

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b - 1 begin, and where the last of them ends."""
        ends = self.ends.between(max(0, a - 1), b)
        return ends if a else np.append(0, ends)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of document i alone."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def read_segment(raw: bytes) -> Segment:
    if raw[: len(MAGIC)] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a whole segment file")
    size, none, base, n = struct.unpack_from("<BIqQ", raw, len(MAGIC))
    keys = EliasFano(raw, len(MAGIC) + struct.calcsize("<BIqQ"))
    ends = EliasFano(raw, keys.end)
    ids = np.frombuffer(raw, f"<u{size}", n, ends.end)
    return Segment(none, base, keys, ends, ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of whole texts, ``end_id`` after each document, as segments in ascending order of doc_id.

    Columns: part (rising with doc_id), seq (within the part), n_ids, segment.
    Null texts are empty; rows without a doc_id come first, and rows that share
    one are in order of their texts. An empty table writes no segment.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, part = encoder(tokenizer), None
        held, ids, size, seq = [], [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([write_segment(held, ids)], pa.binary())],
                ["part", "seq", "n_ids", "segment"],
            )

        for parts, docs_, texts in rows_of(batches, "part", "doc_id", "text"):
            part = parts[0] if parts else part
            for k in range(0, len(texts), 64):
                for d, got in zip(docs_[k : k + 64], encode([t or "" for t in texts[k : k + 64]]), strict=True):
                    if held and size + len(got) // 4 + 1 > segment_ids:
                        yield flush()
                        held, ids, size, seq = [], [], 0, seq + 1
                    held.append(d)
                    ids.append(got + end)
                    size += len(got) // 4 + 1
        if held:
            yield flush()

    ranged = docs.select("doc_id", "text").repartitionByRange(width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    in_batches(ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")).mapInArrow(run, "part int, seq int, n_ids long, segment binary").write.parquet(path)


#: Segments whose starts may be broadcast, at 16 bytes each; more are joined by a shuffle.
BROADCAST_SEGMENTS = 1_000_000


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a segment table, ids as little-endian 32-bit integers.

    start counts the ids of all documents before it. Only one row a segment
    goes through the ordered sum, never a row a document.
    """
    before = segments.select("part", "seq", "n_ids").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = segments.select("part", "seq", inside.alias("inside")).join(before, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("at"))

    def run(batches):
        for ats, blobs in rows_of(batches, "at", "segment"):
            for at, raw in zip(ats, blobs, strict=True):
                segment = read_segment(raw)
                for k in range(0, len(segment), SAMPLE):
                    stop = min(len(segment), k + SAMPLE)
                    bounds = segment.bounds(k, stop)
                    own = [segment.ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(segment.documents(k, stop), pa.int64()), pa.array(bounds[:-1] + at, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(own, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    if segments.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    return segments.join(starts, ["part", "seq"]).select("at", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
