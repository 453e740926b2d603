"""Document quality by a factorisation machine.

Inputs of a score come from the text alone: hashed words (weighted by the square
root of their share of the text), structure statistics and length metadata,
the latter two as one-hot bins. The model is
``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pair sum is half of
``|sum v_i x_i|^2 - sum |v_i|^2 x_i^2``, so scoring is linear in the features.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of

#: Hash buckets of words, bins of a statistic, rank of the pair weights.
BUCKETS, BINS, RANK = 4096, 12, 8
#: Labelled rows that a model is fitted on at most: fixed, whatever the corpus' size.
TRAIN_ROWS = 6000
STATS = (
    "length", "words", "distinct", "word_length", "top_word", "repeat", "upper", "digit", "mark", "marks_in_row",
    "bar", "lines", "line_repeat", "line_end", "first_upper", "trigram_repeat",
)
WIDTH = BUCKETS + BINS * len(STATS)
_upper, _digit, _mark, _run = (re.compile(p) for p in (r"[A-Z]", r"[0-9]", r"[^\w\s.,]", r"[^\w\s]{2,}"))


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """One value from 0 to 1 per name of STATS."""
    n, w, d = max(1, len(text)), max(1, len(words)), max(1, len(counts))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    return [
        log2(1 + len(text)) / 24, log2(1 + len(words)) / 20, d / w, min(1.0, sum(map(len, words)) / w / 20),
        max(counts.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(_upper.findall(text)) / n, len(_digit.findall(text)) / n * 4, min(1.0, len(_mark.findall(text)) / w),
        min(1.0, len(_run.findall(text)) / w), min(1.0, text.count("|") / w), min(1.0, m / w * 4),
        1 - len(set(lines)) / m, sum(x.rstrip()[-1:] in ".!?" for x in lines) / m,
        sum(x[:1].isupper() for x in words) / w, 1 - len(grams) / max(1, w - 2),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a whole text's features; null counts as empty."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = [min(BINS - 1, int(BINS * max(0.0, min(1.0, s)) ** 0.5)) for s in statistics(text, words, counts)]
    at = np.array([crc32(x.lower().encode()) % BUCKETS for x in counts], np.int64)
    value = np.sqrt(np.fromiter(counts.values(), float, len(counts)) / max(1, len(words)))
    summed = np.bincount(at, value, BUCKETS) if len(at) else np.zeros(BUCKETS)
    at = np.flatnonzero(summed)
    value = summed[at] / max(1e-9, float(np.sqrt((summed[at] ** 2).sum())))
    return np.concatenate([at, [BUCKETS + BINS * i + b for i, b in enumerate(stats)]]), np.concatenate([value, np.full(len(stats), len(stats) ** -0.5)])


def score(model: dict, at: np.ndarray, value: np.ndarray) -> float:
    v = model["v"][at] * value[:, None]
    s = v.sum(axis=0)
    return 1 / (1 + np.exp(-np.clip(model["w0"] + float(model["w"][at] @ value) + 0.5 * float(s @ s - (v * v).sum()), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.03, seed: int = 7) -> dict:
    """Adam on the logistic loss, one minibatch of 64 rows at a time. Without rows of both classes every score is the share of ones, or 0.5."""
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(WIDTH), "v": np.zeros((WIDTH, RANK))}
    ones = sum(y for *_, y in rows)
    if not 0 < ones < len(rows):
        model["w0"] = 0.0 if not rows else (30.0 if ones else -30.0)
        return model
    model["w0"] = float(np.log(ones / (len(rows) - ones)))
    both = np.concatenate([model["w"][:, None], rng.normal(0, 0.05, (WIDTH, RANK))], axis=1)
    m, s, step, b = np.zeros_like(both), np.zeros_like(both), 0, model["w0"]
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            part = [rows[i] for i in order[k : k + 64]]
            cut = np.cumsum([0, *[len(p[0]) for p in part]])
            at, x, y = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])[:, None], np.array([p[2] for p in part], float)
            own = both[at]
            vx = own[:, 1:] * x
            total = np.add.reduceat(vx, cut[:-1])
            z = b + np.add.reduceat(own[:, :1] * x, cut[:-1])[:, 0] + 0.5 * ((total**2).sum(1) - np.add.reduceat(vx * vx, cut[:-1]).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
            each = np.repeat(np.arange(len(part)), np.diff(cut))
            d = np.concatenate([x, x * (total[each] - vx)], axis=1) * g[each][:, None]
            touched, where = np.unique(at, return_inverse=True)
            grad = np.zeros((len(touched), RANK + 1))
            np.add.at(grad, where, d)
            grad += 1e-4 * both[touched]
            step += 1
            m[touched] = 0.9 * m[touched] + 0.1 * grad
            s[touched] = 0.99 * s[touched] + 0.01 * grad**2
            both[touched] -= rate * (1 - epoch / epochs) * m[touched] / (np.sqrt(s[touched]) + 1e-8) * min(1.0, step / 50)
            b -= rate * float(g.sum())
    return {"w0": b, "w": both[:, 0].copy(), "v": both[:, 1:].copy()}


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``train_rows`` labelled rows that are not held out, chosen by a hash of doc_id.

    Rows with a null doc_id or label take no part; a document labelled twice counts with its lower label.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )

    def run(batches):
        for ids, texts, ys in rows_of(batches, "doc_id", "text", "y"):
            got = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary()), pa.array(ys, pa.int32())],
                ["doc_id", "at", "value", "y"],
            )

    # the chosen ids are at most train_rows longs, so the broadcast is bounded
    own = in_batches(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"))
    rows = own.mapInArrow(run, "doc_id long, at binary, value binary, y int").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.value)))
    return fit([(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.value, np.float32).astype(float), r.y) for r in rows])


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a column ``fm_score`` (0 to 1, higher is better), every row and column kept; an older fm_score is replaced."""
    docs = docs.drop("fm_score")
    fields = [f.name for f in docs.schema.fields]
    out = T.StructType([*docs.schema.fields, T.StructField("fm_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = pa.array([score(model, *features(t)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*fields, "fm_score"])

    return in_batches(docs).mapInArrow(run, out)
