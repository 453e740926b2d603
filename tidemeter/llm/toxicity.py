"""Toxic passages by maximum-scoring segments of token log-odds.

A token is a run of letters in lower case. Its log-odds between toxic and other
labelled documents is smoothed along its prefixes: the share of toxic documents
among those with a prefix is a Dirichlet prior for the next longer one, down
to the whole word, so a new word is scored as its stem is. Less a drift that makes
common words negative, these are the scores of a text's tokens; one linear scan finds
all of its maximal scoring segments (none can be extended or shortened
for a better sum). Highest segments of n tokens of clean text follow an extreme-value law,
``P(S > x) = 1 - exp(-K n exp(-rate x))``: what a segment exceeds its typical maximum
by is its evidence, and a document's evidence is that of its significant segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of

#: Hash buckets of pieces of words, and the lengths of prefixes that are pieces.
BUCKETS, PREFIXES = 1 << 19, (3, 4, 5, 6, 7)
#: Weight of a shorter piece's share in documents, and what is taken off each score.
WEIGHT, DRIFT = 4.0, 1.0
#: Labelled rows that a model is fitted on at most: fixed, whatever the corpus' size.
TRAIN_ROWS = 20_000
#: Bytes of the memory of word scores in a worker.
WORDS = 48 << 20
EULER = 0.5772156649015329
_word = re.compile(r"[^\W\d_]+")


def pieces(word: str) -> Iterator[int]:
    """Buckets of a word's prefixes, shortest first, and of the whole word."""
    for n in PREFIXES:
        if n < len(word):
            yield crc32(word[:n].encode("utf-8", "surrogatepass")) % BUCKETS
    yield crc32(f"{word} ".encode("utf-8", "surrogatepass")) % BUCKETS


class Scores(dict):
    """Score of each word; own (0 or 1: the class of a labelled document that the counts hold) leaves that document out."""

    def __init__(self, model: dict, own: int | None = None):
        super().__init__()
        # lists, as single values of an array are slow to read
        self.toxic, self.other, self.base = model["toxic"].tolist(), model["other"].tolist(), model["base"]
        self.less = (int(own == 1), int(own == 0))
        self.odds = log(self.base / (1 - self.base)) + DRIFT
        self.room = WORDS

    def __missing__(self, word: str) -> float:
        share, (less_t, less_c) = self.base, self.less
        for b in pieces(word.lower()):
            t, c = self.toxic[b] - less_t, self.other[b] - less_c
            if t + c <= 0:
                # what no document begins with, none goes on with
                break
            t, c = max(0, t), max(0, c)
            share = (t + WEIGHT * share) / (t + c + WEIGHT)
        got = log(share / (1 - share)) - self.odds
        self.room -= 160 + 2 * len(word)
        if self.room > 0:
            self[word] = got
        return got


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, sum) of all maximal scoring segments, in order.

    One pass over the positive scores with running sums: each joins the nearest segment before it whose start lies
    lower, if its end lies lower too; what is joined is looked at once.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list] = []  # first, end, sum before, sum at the end, nearest segment with a lower start
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, float(sums[i]), float(sums[i + 1]), -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append(new)
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


def text_segments(text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the maximal scoring segments over them. A word that has just been said says nothing more: its repeats score the drift alone."""
    words = _word.findall(text or "")
    own = np.fromiter(map(scores.__getitem__, words), float, len(words))
    again = np.fromiter(map(eq, words, words[1:]), bool, max(0, len(words) - 1))
    own[1:][again] = -DRIFT
    return len(words), segments(own)


def evidence(n: int, found: list[tuple[int, int, float]], law: dict) -> float:
    """Sum of what significant segments exceed the typical maximum of n clean tokens by, in units of the law."""
    typical = np.log(max(1, n)) + law["log_k"]
    return float(sum(x for *_, s in found if (x := law["rate"] * s - typical) > law["least"]))


def fitted_law(clean: list[tuple[int, float]], histogram: dict[int, int]) -> dict:
    """rate and log_k of the extreme-value law.

    The rate solves ``E exp(rate s) = 1`` over clean tokens' scores (histogram: tenths, counts); K follows from the
    mean of clean texts' maxima (tokens, best sum). Where clean tokens never score, the rate is that of exact log-odds, 1.
    """
    x = np.array([k / 10 for k in histogram], float)
    p = np.array([*histogram.values()], float)
    rate = 1.0
    if len(x) and x.max() > 0 and (p @ x) < 0:
        low, high = 1e-3, 8.0
        for _ in range(60):
            rate = (low + high) / 2
            low, high = (low, rate) if p @ np.exp(np.clip(rate * x, -60, 60)) > p.sum() else (rate, high)
    rate = min(2.0, max(0.25, rate))
    tops = [rate * s - np.log(n) for n, s in clean if n]
    return {"rate": rate, "log_k": float(np.mean(tops)) - EULER if tops else 0.0, "least": 3.0}


def fitted_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic regression with a weak prior on the slope; by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(2), np.array([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(n: int, found: list[tuple[int, int, float]], model: dict) -> float:
    x = np.log1p(evidence(n, found, model["law"]))
    return float(1 / (1 + np.exp(-np.clip(model["line"][0] + model["line"][1] * x, -30, 30))))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``train_rows`` labelled rows that are not held out, chosen by a hash of doc_id.

    Rows with a null doc_id or label take no part; a document labelled twice is toxic if any label says so, one that
    stands twice counts twice. Counts of pieces of words are summed on the executors and come to the driver by bucket;
    the extreme-value law and the line from evidence to score are fitted on the same rows, each scored by counts without itself.
    Without toxic rows, or without others, every score is the share of toxic ones, or 0.5.
    """
    # at most train_rows longs, so the broadcast is bounded
    chosen = F.broadcast(
        labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    own = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y")

    def count(batches):
        held = np.zeros((2, BUCKETS + 1), np.int64)
        for texts, ys in rows_of(batches, "text", "y"):
            for text, y in zip(texts, ys, strict=True):
                held[int(y == 1), [BUCKETS, *{b for w in {*_word.findall((text or "").lower())} for b in pieces(w)}]] += 1
        at = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, held[1][at], held[0][at])], ["bucket", "toxic", "other"])

    # what one document alone has says nothing about others
    sums = in_batches(own).mapInArrow(count, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    got = sums.where(f"toxic + other > 1 or bucket = {BUCKETS}").toPandas()
    model = {k: np.zeros(BUCKETS + 1, np.int32) for k in ("toxic", "other")}
    for k in model:
        model[k][got["bucket"]] = got[k]
    ones, rows = int(model["toxic"][-1]), int(model["toxic"][-1] + model["other"][-1])
    model |= {"base": ones / rows if 0 < ones < rows else 0.5, "law": {"rate": 1.0, "log_k": 0.0, "least": 3.0}, "line": (0.0, 0.0)}
    if not 0 < ones < rows:
        model["line"] = (0.0 if not rows else 30.0 if ones else -30.0, 0.0)
        return model

    def tops(batches):
        scores = [Scores(model, 0), Scores(model, 1)]
        for texts, ys in rows_of(batches, "text", "y"):
            found = [text_segments(t, scores[int(y == 1)]) for t, y in zip(texts, ys, strict=True)]
            clean = Counter(round(10 * scores[0][w]) for t, y in zip(texts, ys, strict=True) if y != 1 for w in _word.findall(t or ""))
            first = [[*clean.items()], *[[]] * (len(texts) - 1)][: len(texts)]
            columns = [int(y == 1) for y in ys], [n for n, _ in found], [[x for *_, x in f] for _, f in found], [[k for k, _ in f] for f in first], [[n for _, n in f] for f in first]
            kinds = pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["y", "n", "sums", "tenths", "counts"])

    each = in_batches(own).mapInArrow(tops, "y int, n long, sums array<double>, tenths array<long>, counts array<long>").collect()
    histogram = Counter()
    for r in each:
        histogram.update(dict(zip(r.tenths, r.counts, strict=True)))
    model["law"] = fitted_law(sorted((r.n, max(r.sums, default=0.0)) for r in each if not r.y), dict(sorted(histogram.items())))
    rows = sorted((r.y, np.log1p(evidence(r.n, [(0, 0, s) for s in r.sums], model["law"]))) for r in each)
    model["line"] = fitted_line(np.array([x for _, x in rows]), np.array([y for y, _ in rows], float))
    return model


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs with ``toxic_score`` (0 to 1) and ``toxic_passages``, an array of (start, end, bits): the significant segments in code points, end exclusive.

    Whole texts, null as empty (which scores as a text without evidence); every row and column is kept, repeated rows
    stay repeated, older columns of these names are replaced. Time is linear in a text.
    """
    docs = docs.drop("toxic_score", "toxic_passages")
    fields = [f.name for f in docs.schema.fields]
    passage = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bits", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
    law = model["law"]

    def run(batches):
        scores = Scores(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got, spans = [], []
            for text in texts:
                n, found = text_segments(text, scores)
                got.append(score(n, found, model))
                typical = np.log(max(1, n)) + law["log_k"]
                high = [(a, b, law["rate"] * s - typical) for a, b, s in found if law["rate"] * s - typical > law["least"]]
                at = [m.span() for m in _word.finditer(text)] if high else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1], "bits": float(x / np.log(2))} for a, b, x in high])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array(spans, arrow)], [*fields, "toxic_score", "toxic_passages"])

    return in_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_passages", passage)]))
