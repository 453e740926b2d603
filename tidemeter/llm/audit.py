"""How filters act together: the removals of every order, and each filter's share of them.

Documents are counted by which filters they fail, a row for each of 32 sets. A
coalition of filters removes what fails any of them, and that number is its worth in a
game whose potential is found coalition by coalition:
``P(S) = (v(S) + sum of P(S - i)) / |S|``. A filter's Shapley value is the potential of
all filters less that of all but it. Differences of coalitions' worths are the steps of any order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_of

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: What separates words: tab to carriage return, and space.
SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic), a row a document: bits of the filters it fails, and whether a label calls it good or toxic.

    Null texts are empty, a null source is ''. Filter E compares with rows of a smaller doc_id only: rows that share
    an id do not fail for one another, and a null id neither fails nor makes another fail. Documents without a label are neither good nor toxic; any label of several counts.

    Texts are read once; what is shuffled is a digest a row. The first id of each text
    joins by (id, digest), which is never a hot key, whatever text recurs.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.btrim(text, F.lit(SPACE)).alias("_t"))
    own = own.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", r"[\x20\x09-\x0D]+")))
    n, distinct = F.size("_w"), F.size(F.array_distinct("_w"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    fails = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length("text"), F.col("text").rlike(r"[#$%&*|]"))
    bits = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    rows = cut(own.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    # rows without an id meet nothing and are dealt by their text
    with_id = rows.where("doc_id is not null").join(said, "doc_id", "left").join(first, ["doc_id", "digest"], "left")
    fails_e = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = rows.where("doc_id is null").select("part", F.col("bits").alias("fails"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return with_id.select("part", (F.col("bits") + fails_e).alias("fails"), zero("good"), zero("toxic")).unionByName(none)


def worths(counts: list[int]) -> list[int]:
    """Of each coalition, what fails any of its filters; counts: by the exact set of filters failed."""
    return [sum(n for fails, n in enumerate(counts) if fails & s) for s in range(SETS)]


def potentials(worth: list[int]) -> list[int]:
    """|S|! times the potential of each coalition S, which is whole."""
    out = [0] * SETS
    for s in range(1, SETS):
        out[s] = factorial(s.bit_count() - 1) * worth[s] + sum(out[s ^ 1 << k] for k in range(len(FILTERS)) if s >> k & 1)
    return out


def shapley(worth: list[int]) -> list[int]:
    """Of each filter, its removals summed over all orders: as many times its Shapley value as there are orders."""
    p, everyone = potentials(worth), SETS - 1
    return [p[everyone] - len(FILTERS) * p[everyone ^ 1 << k] for k in range(len(FILTERS))]


def steps(counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """(filter_order, step, *COLUMNS) for every order of the filters, from counts by the set of filters failed."""
    v, g, x = worths(counts), worths(good), worths(toxic)
    total, everyone, share = sum(counts), SETS - 1, shapley(v)
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            now = before | 1 << k
            removed = v[now] - v[before]
            out.append((name, step, total - v[now], removed, v[1 << k] - removed, v[everyone] - v[everyone ^ 1 << k], g[now] - g[before], x[now] - x[before], share[k]))
            before = now
    return out


def audit(rows: DataFrame) -> DataFrame:
    """(part, filter_order, step, *COLUMNS): every step of every order in each part of failures() rows. A table without rows has no parts."""
    sums = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # at most a row a set of filters
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))

    def run(batches):
        for names, sets in rows_of(batches, "part", "sets"):
            for part, held in zip(names, sets, strict=True):
                by = {h["fails"]: h for h in held}
                got = steps(*[[by[s][c] if s in by else 0 for s in range(SETS)] for c in ("n", "good", "toxic")])
                kinds = pa.string(), pa.int32(), *[pa.int64()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(got), pa.string()), *[pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)]], ["part", "filter_order", "step", *COLUMNS])

    return parts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COLUMNS)}")
