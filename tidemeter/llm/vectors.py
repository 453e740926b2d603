"""Vector search: exact top-k by the threshold algorithm, and approximate
nearest neighbours by cross-polytope hashing.

Both first fold equal vectors into one class that holds its smallest ids, as
many as any query can return; a vector that fills a third of the table is then
one row, and as a query it is searched for once. Queries meet candidates in
blocks: a bounded block of each in one task, of which only the best few leave it.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, width


def usable(vectors: DataFrame, kind: str = "array<double>") -> DataFrame:
    """(vec_id, vector): rows with an id and a vector of finite components, as ``kind``; repeated rows once."""
    v = vectors.select("vec_id", F.col("embedding").cast(kind).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where("vec_id is not null and vector is not null").where(F.coalesce(fine, F.lit(False)))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): one row a distinct vector, with its ``keep`` smallest ids in order.

    A query returns at most keep - 1 of them besides itself, so no other can be in a result.
    """
    # sorts compare a number first: vectors only where it is equal
    each = vectors.withColumn("_h", F.xxhash64("vector"))
    each = each.withColumn("_r", F.dense_rank().over(Window.partitionBy("_h", "vector").orderBy("vec_id"))).where(F.col("_r") <= keep)
    return each.groupBy("_h", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).drop("_h")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def expand(query: int, scores, ids: list, k: int) -> list[tuple]:
    """A query's best k (query_id, vec_id, score) from classes."""
    got = sorted((-s, i) for s, own in zip(scores, ids, strict=True) for i in own if i != query)[:k]
    return [(query, i, -s) for s, i in got]


def threshold_search(q: np.ndarray, block: np.ndarray, order: np.ndarray, k: int, first: int = 16, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of ``block`` with the k highest inner products with q (ties to the earlier row), those products, and how many rows were scored.

    Fagin's threshold algorithm: ``order`` holds each dimension's rows by
    rising value. Sorted access goes down every list from the end that q's sign
    prefers; each row met is scored at once; the products at the present depth sum
    to the most that an unmet row can reach, and the search stops once that is
    below the kth score, or below ``floor``, a score that k rows elsewhere reach:
    rows below it may be missing. Lists are read a doubling stretch at a time.
    """
    n = len(block)
    up = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    seen = np.zeros(n, bool)
    rows, scores, met = np.zeros(0, np.int64), np.zeros(0, block.dtype), 0
    a, b = 0, min(n, first)
    if not len(up[0]) + len(up[1]):
        rows = np.arange(min(k, n))
        return rows, np.zeros(len(rows), block.dtype), len(rows)
    while a < n:
        high, low = order[n - b : n - a][:, up[0]], order[a:b][:, up[1]]
        hit = np.zeros(n, bool)
        hit[high.ravel()] = True
        hit[low.ravel()] = True
        fresh = np.flatnonzero(hit & ~seen)
        seen |= hit
        met += len(fresh)
        own = block[fresh] @ q
        if floor is not None:
            fresh, own = fresh[own >= floor], own[own >= floor]
        rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, own])
        if len(rows) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[keep], scores[keep]
            keep = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[keep], scores[keep]
        bound = (block[high[0], up[0]] * q[up[0]]).sum() + (block[low[-1], up[1]] * q[up[1]]).sum()
        if floor is not None and bound < floor or len(rows) == k and bound < scores.min():
            break
        a, b = b, min(n, 2 * b)
    keep = np.lexsort((rows, -scores))
    return rows[keep], scores[keep], met


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x), exactly.

    vectors and queries have vec_id and embedding. A query first searches one
    block of candidates; the score that k others reach there is the floor of its search in
    all other blocks. A query is not its own candidate. Vectors null or with null or
    non-finite components take no part; those of another length are no candidates of a
    query; a row repeated whole counts once. Products beyond 64 bits wrap.
    """
    whole = lambda c: F.transform(c, lambda x: F.floor(x * F.lit(float(scale))))
    own = usable(vectors).select("vec_id", whole("vector").alias("vector"))
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), whole("vector").alias("vector")).distinct()
    folded = cut(classes(own, k + 1))
    n, m = folded.count(), asked.count()
    parts = max(-(-n // block), min(width(vectors.sparkSession), -(-n // 512)), 1)
    turns = max(-(-m // query_block), 1)
    asked = cut(asked.select("*", F.size("vector").alias("d"), F.pmod(F.xxhash64("query_id"), F.lit(turns)).alias("qb"), F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int").alias("home")))
    right = folded.select("*", F.size("vector").alias("d"), F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(turns - 1).cast("bigint"))).alias("qb"))

    def search(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asks) and len(rows):
            rows = rows.assign(low=[i[0] for i in rows["ids"]]).sort_values("low")
            data, ask = np.stack(rows["vector"].to_list()), np.stack(asks["vector"].to_list())
            ids = [list(map(int, i)) for i in rows["ids"]]
            if data.shape[1] * float(np.abs(data.astype(float)).max(initial=0)) * float(np.abs(ask.astype(float)).max(initial=0)) < 2**53:
                data, ask = data.astype(float), ask.astype(float)  # exact, and faster
            order = np.argsort(data, axis=0, kind="stable").astype(np.int32)
            for query, q, floor in zip(asks["query_id"], ask, asks["floor"], strict=True):
                at, scores, _ = threshold_search(q, data, order, k + 1, floor=None if pd.isna(floor) else int(floor))
                out += expand(int(query), [int(s) for s in scores], [ids[i] for i in at], k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def meet(left: DataFrame) -> DataFrame:
        keys = ["d", "qb", "cb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")

    first = cut(meet(asked.select("*", F.col("home").alias("cb"), F.lit(None).cast("bigint").alias("floor"))))
    if parts == 1:
        return best(first, k)
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).drop("n")
    others = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(parts - 1)), F.col("home"))).alias("cb")
    # an id that stands with several vectors is as many queries: no floor of one holds for the other
    single = asked.groupBy("query_id").agg(F.count("*").alias("n")).where("n = 1").select("query_id")
    rest = meet(asked.select("*", others).join(floors.join(single, "query_id"), "query_id", "left"))
    return best(first.unionByName(rest), k)


def hadamard(y: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each column, which may overwrite y; the column length is a power of two."""
    d, n = y.shape
    other = np.empty_like(y)
    h = 1
    while h < d:
        z, into = (w.reshape(d // (2 * h), 2, h, n) for w in (y, other))
        np.add(z[:, 0], z[:, 1], out=into[:, 0])
        np.subtract(z[:, 0], z[:, 1], out=into[:, 1])
        y, other = other, y
        h *= 2
    return y


def rotated(x: np.ndarray, table: int, level: int, tile: int = 512) -> np.ndarray:
    """Products of each row with the signed axes of a table's pseudo-rotation: three rounds of random signs and Hadamard."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([table, level, d]).choice([-1.0, 1.0], (3, d))
    out = np.empty((len(x), 2 * d))
    for a in range(0, len(x), tile):
        few = x[a : a + tile]
        y = np.zeros((d, len(few)))  # vectors are columns, so that every step runs along memory
        y[: x.shape[1]] = few.T
        for s in signs:
            y *= s[:, None]
            y = hadamard(y)
            y /= d**0.5
        out[a : a + tile, :d] = y.T
    np.negative(out[:, :d], out=out[:, d:])
    return out


def codes(x: np.ndarray, table: int, levels: int) -> np.ndarray:
    """The bucket of each row: its nearest signed axis in each of ``levels`` rotations, as the digits of one number."""
    out = np.zeros(len(x), np.int64)
    for level in range(levels):
        own = rotated(x, table, level)
        out = out * own.shape[1] + own.argmax(axis=1)
    return out


def probed(x: np.ndarray, table: int, levels: int, probes: int) -> np.ndarray:
    """The ``probes`` buckets of each row whose axes have the highest products with it in sum, best first; fewer if there are fewer."""
    best_codes, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for level in range(levels):
        own = rotated(x, table, level)
        order = np.argsort(-own, axis=1, kind="stable")
        value = np.take_along_axis(own, order, 1)
        # of two falling lists, the sum of entries i and j has (i + 1)(j + 1) - 1 sums above it
        i, j = np.meshgrid(np.arange(total.shape[1]), np.arange(own.shape[1]), indexing="ij")
        i, j = (z[(i + 1) * (j + 1) <= probes] for z in (i, j))
        both = total[:, i] + value[:, j]
        top = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        best_codes = np.take_along_axis(best_codes[:, i] * own.shape[1] + order[:, j], top, 1)
        total = np.take_along_axis(both, top, 1)
    return best_codes


#: Hash tables; the most buckets a query looks into in each; rows of a block, and queries, that meet in one task.
TABLES, MOST_PROBES, CHUNK, QUERY_CHUNK = 16, 2048, 65536, 32768
#: Components of the rows of a block, and of its queries, at most; buckets that the queries of a block look into.
CHUNK_SIZE, QUERY_SIZE, CHUNK_LOOKS = 1 << 22, 1 << 21, 1 << 22
#: Tables that the first look goes to. Large blocks whose keys may be broadcast, at 40 bytes each; more are joined by a shuffle.
FIRST_TABLES, BROADCAST_BLOCKS = 2, 100_000
#: The number of probes is fitted on so many queries at most for this share of their true neighbours.
FIT_QUERIES, FIT_RECALL = 64, 0.95
#: What a look into a bucket costs, in products with a row of it.
LOOK_COST = 60
#: Products in one matrix; a bucket with fewer than the second is computed together with others.
PRODUCTS, FEW_PRODUCTS = 1 << 20, 256


def levels_for(n: int, d: int) -> int:
    """The most rotations whose axes may together make a bucket, so that it holds a few rows: two at least, more as rows grow. fitted() chooses."""
    return max(2, min(ceil(log(max(n, 8) / 8, axes(d))), int(60 // log(axes(d), 2))))


def listed(batch, name: str, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list column without nulls."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.diff(column.offsets.to_numpy())


def matrix(batch, name: str = "vector") -> np.ndarray:
    flat, sizes = listed(batch, name)
    return flat.reshape(len(sizes), -1)


def fitted(folded: DataFrame, asked: DataFrame, k: int, tables: int, counts: dict[int, int]) -> tuple[dict[int, tuple[int, int | None]], dict[int, float]]:
    """For each vector length the rotations that make a bucket, and the probes a table with which FIT_RECALL of the true neighbours of at most FIT_QUERIES queries are found.

    Of two rotations up to levels_for(), those that cost least: finer buckets
    hold fewer rows, but need so many more probes that at some sizes MOST_PROBES are not
    enough. The probes are None where they are enough with no number of rotations.

    And a score, as a share of a query's norm, that twice as many rows as are asked for
    reach for each of these queries, where so many rows are met. It is expected to be too high for one in
    FIT_QUERIES others, whose search must be done again without it.
    """
    some = asked.withColumn("_r", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("vector"), "q"))).where(F.col("_r") <= FIT_QUERIES)
    held = {d: np.array([r.vector for r in rows]) for d, rows in _by_length(some.select("d", "vector").collect()).items()}

    def near(batches):
        for batch in batches:
            for d in pa.compute.unique(batch.column("d")).to_pylist():
                own = batch.filter(pa.compute.equal(batch.column("d"), d))
                if d in held:
                    x = matrix(own)
                    scores = held[d] @ x.T
                    top = np.argsort(-scores, axis=1, kind="stable")[:, : 2 * (k + 1)]
                    at = top.ravel()
                    who = np.repeat(np.arange(len(top)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d), pa.int32()), pa.array(who, pa.int32()), pa.array(scores[who, at]), own.column("c").take(pa.array(at))], ["d", "who", "score", "c"])

    found = in_batches(folded.select("d", "vector", "c")).mapInArrow(near, "d int, who int, score double, c long")
    order = Window.partitionBy("d", "who").orderBy(F.desc("score"), "c")
    ranked = cut(found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * (k + 1)))
    low: dict[int, float] = {}
    for d, rows in _by_length(ranked.where(F.col("_r") == 2 * (k + 1)).collect()).items():
        if len(rows) == len(held[d]):
            low[d] = min(r.score / float(np.linalg.norm(held[d][r.who])) for r in rows)
    out: dict[int, tuple[int, int | None]] = {}
    nearby = folded.join(F.broadcast(ranked.where(F.col("_r") <= k + 1).select("c", "who")), "c")
    for d, rows in _by_length(nearby.select("d", "who", "vector").collect()).items():
        who, x = np.array([r.who for r in rows]), np.array([r.vector for r in rows])
        least = None
        for levels in range(2, levels_for(counts[d], d) + 1):
            first = np.full(len(rows), MOST_PROBES)
            for t in range(tables):
                hit = probed(held[d], t, levels, MOST_PROBES)[who] == codes(x, t, levels)[:, None]
                first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
            probes = int(np.sort(first)[ceil(FIT_RECALL * len(first)) - 1]) + 1
            cost = probes * (counts[d] / axes(d) ** levels + LOOK_COST)
            if probes <= MOST_PROBES and (least is None or cost < least):
                least, out[d] = cost, (levels, probes)
        out.setdefault(d, (2, None))
    return out, low


def axes(d: int) -> int:
    """Signed axes of a rotation of vectors of length d."""
    return 2 << max(1, (d - 1).bit_length())


def _by_length(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.d, []).append(r)
    return out


def products(asks: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(q, c, low, score): of the rows in the buckets that each query of a block looks into, the k + 1 best, none below its ``least``; a query without buckets looks into all.

    A bucket is one matrix of products with all queries that look into it. Which
    rows it leaves is decided with room for rounding; their scores are then computed
    pair by pair, so they do not depend on the block.
    """
    data, ask = matrix(rows), matrix(asks)
    code = rows.column("code").to_numpy()
    order = np.argsort(code, kind="stable")
    data, code, c, low = data[order], code[order], rows.column("c").to_numpy()[order], rows.column("low").to_numpy()[order]
    q, floor = asks.column("q").to_numpy(), np.array(asks.column("least").to_numpy(), float)
    floor[np.isnan(floor)] = -np.inf
    with np.errstate(over="ignore"):
        room = 1e-15 * data.shape[1] * np.linalg.norm(ask, axis=1) * np.linalg.norm(data, axis=1).max()
    kept: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    fresh = 0  # pairs since the last fold

    def hold(w: np.ndarray, at: np.ndarray) -> None:
        nonlocal fresh
        s = np.einsum("ij,ij->i", ask[w], data[at])
        keep = ~(s < floor[w])
        kept.append((w[keep], at[keep], s[keep]))
        fresh += len(kept[-1][0])
        if fresh > PRODUCTS:
            fold()

    def fold() -> None:
        nonlocal fresh
        fresh = 0
        w, at, s = (np.concatenate(x) for x in zip(*kept, strict=True))
        by = np.lexsort((low[at], -s, w))
        w, at, s = w[by], at[by], s[by]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
        nth = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        last = nth == k
        floor[w[last]] = np.fmax(floor[w[last]], s[last])
        kept[:] = [(w[nth <= k], at[nth <= k], s[nth <= k])]

    def meet(who: np.ndarray, begin: int, end: int) -> None:
        step = max(PRODUCTS // (end - begin), 1)
        for a in range(0, len(who), step):
            few = who[a : a + step]
            s = ask[few] @ data[begin:end].T
            bar = floor[few]
            if end - begin > 4 * (k + 1):
                bar = np.fmax(bar, np.partition(s, end - begin - k - 1, axis=1)[:, end - begin - k - 1])
            w, at = np.nonzero(~(s < (bar - room[few])[:, None]))
            if len(w):
                hold(few[w], at + begin)

    flat, sizes = listed(asks, "codes", np.int64)
    whole = np.flatnonzero(sizes == 0)
    if len(whole):
        meet(whole, 0, len(code))
    who = np.repeat(np.arange(len(q)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, who = flat[by], who[by]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    asking = np.diff(np.append(start, len(flat)))
    begin, end = (np.searchsorted(code, flat[start], side) for side in ("left", "right"))
    large = asking * (end - begin) >= FEW_PRODUCTS
    for i in np.flatnonzero(large):
        meet(who[start[i] : start[i] + asking[i]], begin[i], end[i])
    n = np.repeat(np.where(large, 0, end - begin), asking)  # rows that each look meets
    begin = np.repeat(begin, asking)[n > 0]
    who, n = who[n > 0], n[n > 0]
    stop = np.append(np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), 1 << 16), "left"), len(n))
    for a, b in zip(stop[:-1], stop[1:], strict=True):
        if b > a:
            m = n[a:b]
            w = np.repeat(who[a:b], m)
            hold(w, np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[a:b], m))
    fold()
    w, at, s = kept[0]
    return pa.table({"q": q[w], "c": c[at], "low": low[at], "score": s})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, chunk: int = CHUNK, query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by inner product, in double precision.

    Every vector is in one bucket of each table: its nearest signed axes after
    two or more pseudo-rotations. A query looks
    into the buckets whose axes are nearest to it and scores what is there
    exactly: first in two tables, which gives a score to beat, then in
    the others, from which only better rows return. How many rotations and buckets, and which scores are
    too low in the first look, fitted() finds on a bounded sample of queries. Buckets travel in blocks, dealt by all
    axes but the last, so that a query goes once to each block it looks into; large blocks are split on both sides, so
    nothing is capped. Queries that found too few look into every block of one table, as do
    all of a length for which no number of probes up to MOST_PROBES is enough: these are searched exactly.
    Hashing sees directions only: recall is for vectors of about equal length.
    Vectors null, zero or with null or non-finite components take no part, those of
    another length are no candidates, a row repeated whole counts once.
    """
    some = F.exists("vector", lambda x: x != 0)
    # floats stay floats while they travel; every product is one of doubles
    single = dict(vectors.dtypes)["embedding"] == dict(queries.dtypes)["embedding"] == "array<float>"
    kind, arrow = ("array<float>", pa.list_(pa.float32())) if single else ("array<double>", pa.list_(pa.float64()))
    size = lambda x: x.withColumn("d", F.size("vector"))
    named = lambda x, name: x.select(F.monotonically_increasing_id().alias(name), "*")
    folded = cut(named(size(classes(usable(vectors, kind).where(some), k + 1)), "c"))
    ids = cut(usable(queries, kind).where(some).select(F.col("vec_id").alias("query_id"), "vector").distinct())
    # adaptive execution would join what is few bytes and much work to a task or two
    keys, parts = ["d", "t", "block"], width(vectors.sparkSession)
    asked = cut(named(size(ids.select("vector").distinct().repartition(parts, F.xxhash64("vector"))), "q"))
    counts = {r.d: r.n for r in folded.groupBy("d").agg(F.count("*").alias("n")).collect()}
    fit, low = fitted(folded, asked, k, tables, counts)  # lengths that have both rows and queries
    exact = [d for d, (_, n) in fit.items() if n is None]
    room = {d: max(min(chunk, CHUNK_SIZE // d), 1) for d in fit}
    query_room = {d: max(min(query_chunk, QUERY_SIZE // d, CHUNK_LOOKS // (n or 1)), 1) for d, (_, n) in fit.items()}
    blocks = {d: min(axes(d) ** (levels - 1), -(-2 * counts[d] // room[d])) for d, (levels, _) in fit.items()}

    def lengths(batch):
        for d in pa.compute.unique(batch.column("d")).to_pylist():
            if d in fit:
                own = batch.filter(pa.compute.equal(batch.column("d"), d))
                yield d, own, matrix(own)

    def coded(batches):
        for batch in batches:
            for d, own, x in lengths(batch):
                code = np.stack([codes(x, t, fit[d][0]) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [own.column("d"), own.column("c"), own.column("low"), own.column("vector").cast(arrow), pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, tables), pa.int32()), pa.array(code.ravel()))],
                    ["d", "c", "low", "vector", "codes"],
                )

    hashed = in_batches(folded.select("d", "c", F.element_at("ids", 1).alias("low"), "vector").repartition(parts, "c")).mapInArrow(coded, f"d int, c long, low long, vector {kind}, codes array<long>")
    hashed = cut(hashed)

    def placed(at_tables: range) -> DataFrame:
        """Every class with its bucket in these tables."""
        at = F.explode(F.array([F.struct(F.lit(t).alias("t"), F.col("codes")[t].alias("code")) for t in at_tables])).alias("at")
        of = lambda values: F.create_map(*[F.lit(x) for d in fit for x in (d, values(d))])[F.col("d")]
        rows = hashed.select("d", "c", "low", "vector", at).select("d", "at.t", "at.code", "c", "low", "vector")
        block = F.expr("code div axes % blocks").cast("int").alias("block")
        return rows.withColumn("axes", of(axes)).withColumn("blocks", of(lambda d: blocks[d])).select("d", "t", block, "code", "c", "low", "vector")

    def looks(own: DataFrame, at_tables: range) -> DataFrame:
        """Blocks of each query in these tables and the buckets it looks at in them."""

        def run(batches):
            for batch in batches:
                for d, own, x in lengths(batch):
                    step = max((1 << 16) // fit[d][1], 16)
                    least = np.array(own.column("least").to_numpy(zero_copy_only=False), float)
                    if d in low:  # fmax() takes the number where the other is none
                        least = np.fmax(least, low[d] * np.linalg.norm(x, axis=1))
                    for t in at_tables:
                        for at in range(0, len(x), step):
                            code = probed(x[at : at + step], t, *fit[d])
                            who, code = np.repeat(np.arange(len(code)), code.shape[1]), code.ravel()
                            block = code // axes(d) % blocks[d]
                            order = np.lexsort((block, who))
                            who, block, code = who[order], block[order], code[order]
                            begin = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (block[1:] != block[:-1]))[: len(who)])
                            mine = own.take(pa.array(who[begin] + at))
                            yield pa.RecordBatch.from_arrays(
                                [mine.column("d"), pa.array(np.full(len(begin), t), pa.int32()), pa.array(block[begin], pa.int32()), mine.column("q"), pa.array(least[who[begin] + at]), mine.column("vector").cast(arrow), pa.ListArray.from_arrays(pa.array(np.append(begin, len(code)), pa.int32()), pa.array(code))],
                                ["d", "t", "block", "q", "least", "vector", "codes"],
                            )

        own = own.where(~F.col("d").isin(*exact)) if exact else own
        return in_batches(own.select("d", "q", "vector", "least")).mapInArrow(run, f"d int, t int, block int, q long, least double, vector {kind}, codes array<long>")

    def crowded(sizes: DataFrame, most: dict[int, int], name: str) -> DataFrame:
        """Blocks whose n is more than ``most`` of their length, and in how many parts."""
        bound = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("d")]
        return cut(sizes.withColumn(name, F.ceil(F.col("n") / bound).cast("int")).where(f"{name} > 1").drop("n"))

    def asking_in(batches):
        """How many of these queries look into each block."""
        for batch in batches:
            for d, _, x in lengths(batch):
                step = max((1 << 16) // fit[d][1], 16)
                for t in range(tables):
                    n = np.zeros(blocks[d], np.int64)
                    for at in range(0, len(x), step):
                        own = np.sort(probed(x[at : at + step], t, *fit[d]) // axes(d) % blocks[d], axis=1)
                        n += np.bincount(np.concatenate([own[:, 0], own[:, 1:][own[:, 1:] != own[:, :-1]]]), minlength=blocks[d])
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d), pa.int32()), pa.array(np.full(len(at), t), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], [*keys, "n"])

    def search(asks: pa.Table, rows: pa.Table) -> pa.Table:
        if len(asks) and len(rows):
            return products(asks, rows, k)
        return pa.table({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "low": np.zeros(0, np.int64), "score": np.zeros(0)})

    def parted(df: DataFrame, sizes: DataFrame, own: str, n: str, part: str, other: str, m: str) -> DataFrame:
        """df with its part of a large block, once for each part of the other side: both are 0 elsewhere."""
        known = df.join(sizes, keys, "left")
        here, there = (F.coalesce(c, F.lit(1)) for c in (n, m))
        out = known.withColumn(part, F.pmod(F.xxhash64(own), here).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), there - 1)))
        return out.select(*df.columns, part, other).toDF(*df.columns, part, other)  # columns of their own: both sides may come from one table

    def visit(left: DataFrame, at_tables: range, many: DataFrame | None, more: DataFrame | None = None) -> DataFrame:
        """The k + 1 best classes of each query; many: blocks with too many queries for one task, as crowded() counts them."""
        rows, sizes = placed(at_tables), large.withColumn("turns", F.lit(1))
        if many is not None:
            sizes = cut(large.join(many, keys, "full"))
        n = sizes.count()
        sizes = F.broadcast(sizes) if n <= BROADCAST_BLOCKS else sizes
        if n:
            a, b = parted(left, sizes, "q", "turns", "qc", "cc", "chunks"), parted(rows, sizes, "c", "chunks", "cc", "qc", "turns")
        else:
            a, b = (x.select("*", F.lit(0), F.lit(0)).toDF(*x.columns, "qc", "cc") for x in (left, rows))
        by = [*keys, "qc", "cc"]
        found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(search, "q long, c long, low long, score double")
        found = found.unionByName(more) if more is not None else found
        each = found.repartition(parts, "q").groupBy("q", "c").agg(F.max("low").alias("low"), F.max("score").alias("score"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "low")
        return cut(each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r"))

    none = F.lit(None).cast("double").alias("least")
    start = min(FIRST_TABLES, tables)
    if fit:
        large = crowded(placed(range(tables)).groupBy(*keys).agg(F.count("*").alias("n")), room, "chunks")
        to_count = {r.d for r in asked.groupBy("d").agg(F.count("*").alias("n")).collect() if r.d in fit and r.n > query_room[r.d]}
        many = None
        if to_count - {*exact}:
            own = in_batches(asked.where(F.col("d").isin(*to_count - {*exact})).select("d", "vector"))
            sizes = own.mapInArrow(asking_in, "d int, t int, block int, n long").groupBy(*keys).agg(F.sum("n").alias("n"))
            many = crowded(sizes, query_room, "turns")
        first = visit(looks(asked.select("*", none), range(start)), range(start), many)
        enough = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") > k).drop("n")
        found = visit(looks(asked.join(enough, "q", "left"), range(start, tables)), range(start, tables), many, first)
    else:
        found = asked.select("q", F.col("q").alias("c"), F.col("q").alias("low"), none.alias("score")).limit(0)
    short = cut(asked.where(F.col("d").isin(*fit)).join(found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > k), "q", "left_anti"))
    asking = {r.d: r.n for r in short.groupBy("d").agg(F.count("*").alias("n")).collect()}
    if asking:
        every = vectors.sparkSession.createDataFrame([(d, 0, b, -(-n // query_room[d])) for d, n in asking.items() for b in range(blocks[d])], "d int, t int, block int, turns int")
        nowhere = F.array().cast("array<long>").alias("codes")
        all_of = short.join(F.broadcast(every), "d").select("d", "t", "block", "q", none, "vector", nowhere)
        found = found.join(short, "q", "left_anti").unionByName(visit(all_of, range(1), every.where("turns > 1") if any(n > query_room[d] for d, n in asking.items()) else None))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = found.join(folded.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    top = each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select("q", "score", "vec_id")
    whose = ids.join(asked.select("q", "vector"), "vector").select("q", "query_id")
    return best(top.join(whose, "q").where("vec_id <> query_id").select("query_id", "vec_id", "score"), k)
