"""Near copies by an exact Jaccard similarity of word shingles.

Candidates come from buckets in two steps. First every set of shingles has the
seven covering masks of its SimHash fingerprint, and BANDS fingerprints of ROWS
minima each, as a fingerprint of 64 bits alone does not reach a similarity of
0.8 (it differs there in about ten bits). In each bucket all sets are compared
with one pivot, the set that shares the most buckets with others: of texts that were edited
from one original, the original. Where a bucket still holds several components,
its sets get MORE_BANDS narrower fingerprints of MORE_ROWS minima, in whose
buckets texts below the similarity seldom meet; there each set is compared with
every set of another component, so that no pair of a bucket is left out that
could join two. That is done within blocks of a bucket, which send
links alone, no pairs. A link needs the similarity. A pair at just 0.8 misses all buckets of the first step with a
chance of 0.0004 and those of the second with 0.003, by calculation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, in_batches, rows_of
from .simhash import SEED, majority, masks, shingle_hashes, signed

BANDS, ROWS = 20, 5
MORE_BANDS, MORE_ROWS, MINIMA = 128, 14, 256
SHINGLE, SIMILAR = 5, 0.8
#: Sets of a bucket that are compared in one task, with as many others; a larger bucket is several blocks.
BLOCK = 512
_rng = np.random.default_rng(SEED)
_times = _rng.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_plus = _rng.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64)
_picked = np.array([_rng.choice(MINIMA, MORE_ROWS, replace=False) for _ in range(MORE_BANDS)])


def minima(own: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n hash functions over a set."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 1024):
        least = np.minimum(least, (own[None, k : k + 1024] * _times[:n] + _plus[:n]).min(axis=1))
    return least


def key_of(raw: bytes) -> int:
    return signed(xxhash.xxh64_intdigest(raw, SEED))


def set_id(own: np.ndarray) -> int:
    """Equal sets of shingles have equal ids."""
    return key_of(own.tobytes())


def bucket_keys(hashes: np.ndarray, own: np.ndarray) -> list[int]:
    """A key a table; texts without words have none. hashes: of all shingles, own: the distinct ones."""
    if not len(own):
        return []
    fp, raw, n = majority(hashes), minima(own, BANDS * ROWS).tobytes(), 8 * ROWS
    return [signed(fp & m) for m in masks()] + [key_of(raw[k : k + n]) for k in range(0, len(raw), n)]


def narrow_keys(own: np.ndarray) -> list[int]:
    """A key a table of the second step, from the 32-bit set."""
    if not len(own):
        return []
    return [key_of(x.tobytes()) for x in minima(own.astype(np.uint64), MINIMA)[_picked]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, blank, _set, grams, keys) of each row: the set's id, its shingles as sorted 32-bit hashes, and its buckets.

    Shingles of two texts are alike by chance once in 2^32 pairs, which moves no similarity that matters.
    """

    def run(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out = []
            for t in texts:
                hashes = shingle_hashes(t, SHINGLE)
                own = np.unique(hashes)
                out.append((set_id(own), np.unique(own.astype("<u4")).tobytes(), bucket_keys(hashes, own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([t is None for t in texts]), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                ["doc_id", "blank", "_set", "grams", "keys"],
            )

    return in_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, blank boolean, _set long, grams binary, keys array<long>")


def buckets(keyed: DataFrame) -> DataFrame:
    """(_set, t, key, p) of sets that are not alone in a bucket, with its pivot; keyed: (_set, keys)."""
    # equal sets may have unequal fingerprints, as those count a shingle as often as it stands
    each = keyed.select("_set", F.posexplode("keys").alias("t", "key")).distinct()
    shared = each.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(each.join(shared, ["t", "key"]))
    weight = members.groupBy("_set").agg(F.sum("n").alias("w"))
    pivots = members.join(weight, "_set").groupBy("t", "key").agg(F.max_by("_set", F.struct("w", "_set")).alias("p"))
    return cut(members.drop("n").join(pivots, ["t", "key"]))


def similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those pairs (a, b) of sets whose similarity is SIMILAR or more; held: (_set, grams)."""
    pairs = cut(pairs)
    nodes = pairs.select(F.col("a").alias("_set")).union(pairs.select("b")).distinct()
    held = cut(held.join(nodes, "_set", "left_semi").groupBy("_set").agg(F.min("grams").alias("grams")))
    both = pairs.join(held.select(F.col("_set").alias("a"), F.col("grams").alias("ga")), "a").join(held.select(F.col("_set").alias("b"), F.col("grams").alias("gb")), "b")

    def run(batches):
        for a, b, ga, gb in rows_of(batches, "a", "b", "ga", "gb"):
            near = [k for k in range(len(a)) if jaccard(np.frombuffer(ga[k], "<u4"), np.frombuffer(gb[k], "<u4")) >= SIMILAR]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in near], pa.int64()), pa.array([b[k] for k in near], pa.int64())], ["a", "b"])

    return cut(in_batches(both).mapInArrow(run, "a long, b long"))


def with_pivots(members: DataFrame) -> DataFrame:
    """Pairs of a bucket's pivot and its other sets."""
    return members.where("_set <> p").select(F.least("p", "_set").alias("a"), F.greatest("p", "_set").alias("b")).distinct()


def rooted(edges: DataFrame) -> DataFrame:
    """(_set, root) over links (a, b)."""
    return connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("_set"), "root")


def named(members: DataFrame, roots: DataFrame, col: str = "_set", root: str = "root") -> DataFrame:
    return members.join(roots.select(F.col("_set").alias(col), F.col("root").alias(root)), col, "left").withColumn(root, F.coalesce(root, col))


def sharing(grams: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets may reach SIMILAR, as a matrix: those that share one of their rarest shingles.

    Exact: in one order of all shingles, rare ones first, sets of that similarity share one of the first
    n - ceil(SIMILAR n) + 1 of each, n being its size.
    """
    sizes = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(grams)), sizes)
    _, token, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    order = np.lexsort((token, times[token], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < np.repeat(sizes - np.ceil(SIMILAR * sizes - 1e-9).astype(int) + 1, sizes)
    owner, token = owner[order][first], token[order][first]
    by = np.argsort(token, kind="stable")
    owner, token = owner[by], token[by]
    near = np.zeros((len(grams), len(grams)), bool)
    cuts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(token)), strict=True):
        if b - a > 1:
            near[np.ix_(owner[a:b], owner[a:b])] = True
    return near


def joined(rows: pa.Table) -> pa.Table:
    """Links between components in a block, or across two: what has been joined is not compared again. Only pairs that share a rare shingle are looked at."""
    ids, roots, blocks = (rows.column(c).to_pylist() for c in ("_set", "root", "b"))
    grams = [np.frombuffer(g, "<u4") for g in rows.column("grams").to_pylist()]
    one = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    up = {r: r for r in roots}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    near = np.tril(sharing(grams), -1)
    own, block, size = np.array(roots), np.array(blocks), np.array([len(g) for g in grams])
    near &= own[:, None] != own[None, :]
    if not one:
        near &= block[:, None] != block[None, :]
    near &= np.minimum(size[:, None], size[None, :]) >= SIMILAR * np.maximum(size[:, None], size[None, :])
    out = []
    for x, y in np.argwhere(near).tolist():
        if (a := top(roots[x])) != (b := top(roots[y])) and jaccard(grams[x], grams[y]) >= SIMILAR:
            out.append((ids[x], ids[y]))
            up[a] = b
    return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})


def compared(members: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b) between components in the buckets of members (_set, t, key, root); held: (_set, grams)."""
    mixed = members.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 2 and lo <> hi")
    own = members.join(mixed.select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), ["t", "key"])
    own = own.withColumn("b", F.pmod(F.xxhash64("_set"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("_set", "root", "t", "key", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    return cut(own.join(held, "_set").groupBy("t", "key", "i", "j").applyInArrow(joined, "a long, b long"))


def components(own: DataFrame) -> DataFrame:
    """(_set, root): sets of shingles that have near copies, and their components; own: sets()."""
    held = own.select("_set", "grams")
    members = buckets(own.select("_set", "keys"))
    links = similar(with_pivots(members), held)
    roots = rooted(links)
    # two sets of a bucket have been compared: one of them is its pivot
    mixed = named(members, roots).groupBy("t", "key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("n > 2 and a <> b")
    unsure = cut(members.join(mixed, ["t", "key"], "left_semi").select("_set").distinct())
    if unsure.isEmpty():
        return roots

    def narrow(batches):
        for ids, grams in rows_of(batches, "_set", "grams"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([narrow_keys(np.frombuffer(g, "<u4")) for g in grams], pa.list_(pa.int64()))], ["_set", "keys"])

    wanted = held.join(unsure, "_set", "left_semi").groupBy("_set").agg(F.min("grams").alias("grams"))
    members = buckets(in_batches(wanted).mapInArrow(narrow, "_set long, keys array<long>"))
    links = links.unionByName(similar(with_pivots(members), held))
    roots = rooted(links)
    found = compared(named(members, roots), wanted)
    return roots if found.isEmpty() else rooted(links.unionByName(found))


def first_of_each(docs: DataFrame) -> DataFrame:
    """Of each component of near copies one row of docs: the smallest doc_id, of equal ids one whose text is not null, then the least id of a set of shingles, then the first row. Rows without an id stay."""
    own = cut(sets(docs.where("doc_id is not null")))
    roots = components(own)
    order = F.struct("doc_id", "blank", "_set")
    of_set = named(own.groupBy("_set").agg(F.min(order).alias("_r")), roots)
    kept = of_set.groupBy("root").agg(F.min("_r").alias("_r")).select("_r.*")
    return rows_with(docs.where("doc_id is not null"), kept, own).unionByName(docs.where("doc_id is null"))


def rows_with(docs: DataFrame, kept: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of docs that kept (doc_id, blank, _set) names, one each.

    Where an id is one row, the id finds it; sets are hashed again only for
    rows of ids that stand in several.
    """
    names = [f.name for f in docs.schema.fields]
    count = own.groupBy("doc_id", "blank").agg(F.count("*").alias("_n"))
    kept = cut(kept.join(count, ["doc_id", "blank"]).select("doc_id", F.col("blank").alias("_blank"), F.col("_set").alias("_s"), "_n"))
    rows = docs.withColumn("_blank", F.col("text").isNull())
    once = rows.join(kept.where("_n = 1"), ["doc_id", "_blank"], "left_semi").select(*names)
    many = kept.where("_n > 1")
    if many.isEmpty():
        return once
    found = rows.join(many, ["doc_id", "_blank"])
    at = [f.name for f in found.schema.fields]

    def same(batches):
        for batch in batches:
            texts, wanted = (batch.column(at.index(c)).to_pylist() for c in ("text", "_s"))
            yield batch.filter(pa.array([set_id(np.unique(shingle_hashes(t, SHINGLE))) == s for t, s in zip(texts, wanted, strict=True)], pa.bool_()))

    found = in_batches(found).mapInArrow(same, found.schema)
    first = F.row_number().over(Window.partitionBy("doc_id", "_blank", "_s").orderBy(*[c for c in names if c != "doc_id"]))
    return once.unionByName(found.withColumn("_r", first).where("_r = 1").select(*names))
