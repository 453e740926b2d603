"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint of its word shingles; fingerprints that
differ in at most two bits are linked. Seven structured masks form the tables:
bit i belongs to one of the seven non-zero vectors of GF(2)^3 and mask v keeps
the bits whose vector has an odd product with v. Two differing bits span at
most a plane, so some v is orthogonal to both: every pair within the radius
agrees on all bits that this mask keeps, and collides in its table.

Within a colliding bucket no pairs are listed. Members agree on the mask's
bits, so a pair within distance two shares a fingerprint that is at most one
flip of a free bit away from each of them; and whatever shares one is within
distance two. Grouping by that neighbour therefore gives exactly the links, at
most 65 rows a fingerprint, however large the bucket is.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, in_batches, rows_of

SEED = 42


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(bits: int = 64) -> list[int]:
    """The seven masks, for radius two."""
    vector = [i % 7 + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, 8)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle in order, repeats included.

    Letters A-Z count as a-z; words are runs without space, tab or line ends.
    Fewer words than a shingle make one shingle, none (or null) make none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        raw = digest(line, SEED)
    else:
        stops = [*accumulate(len(w) + 1 for w in words)]
        raw = b"".join([digest(line[a : b - 1], SEED) for a, b in zip([0, *stops], stops[shingle - 1 :], strict=False)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(bits), 255):
        ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of docs."""

    def run(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            fps = [signed(fingerprint(t, shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs.

    component_id is the smallest doc_id reachable over links of at most two
    differing bits, the row's own included. Null texts count as empty. Rows
    whose doc_id is null take the component of their fingerprint, or null when
    no row with an id has that fingerprint. Repeated rows stay repeated.
    """
    fps = cut(fingerprints(docs, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    keep = classes.where("rep is not null")
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks())])
    keyed = keep.select("fp", "rep", F.inline(tables))
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("t", "key")
    free = F.element_at(F.array(*[F.lit(signed(m ^ (2**64 - 1))) for m in masks()]), F.col("t") + 1)
    near = keyed.join(shared, ["t", "key"], "left_semi").groupBy("fp", "rep").agg(F.bit_or(free).alias("free"))
    balls = near.select(
        "rep",
        F.explode(
            F.expr(
                "concat(array(fp), transform(filter(sequence(0, 63), b -> (shiftrightunsigned(free, b) & 1L) = 1L), b -> fp ^ shiftleft(1L, b)))"
            )
        ).alias("at"),
    )
    links = balls.select(F.col("rep").alias("u"), F.min("rep").over(Window.partitionBy("at")).alias("v")).where("u <> v")
    roots = connected_components(links)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
