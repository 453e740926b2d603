"""Toxic passages: the linear scan against all segments, the law, and held-out labels."""

import random
from zlib import crc32

import numpy as np

from tidemeter.llm import queries, toxicity

DOC = "doc_id long, text string, toxic_score string, y string, n long"


def slow_segments(scores, first=0):
    """Maximal segments by their definition: the best one (shortest of equals), then those on either side of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return slow_segments(scores[:a], first) + [(first + a, first + b, best[0])] + slow_segments(scores[b:], first + b)


def test_segments_are_all_maximal_ones():
    rng = random.Random(5)
    for n in [0, 1, 2, *[rng.randint(3, 24) for _ in range(300)]]:
        scores = [rng.randint(-40, 30) + rng.random() for _ in range(n)]
        got = toxicity.segments(np.array(scores, float))
        want = slow_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_scan_is_linear():
    import time

    for pattern in ([1.0, -0.5], [1.0, -1.5], [2.0, -1.0, -1.5, 0.7]):
        began = time.time()
        toxicity.segments(np.array(pattern * (400_000 // len(pattern))))
        assert time.time() - began < 8


def test_law_of_coin_flips():
    # scores of +1 and -1 with chances 0.3 and 0.7 have the rate ln(7/3)
    law = toxicity.fitted_law([(100, 5.0)], {10: 300, -10: 700})
    assert abs(law["rate"] - np.log(7 / 3)) < 1e-6


def held_out_agreement(spark, docs, labels):
    model = toxicity.train(docs, labels)
    said = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(said[r.doc_id], r.toxic_score) for r in toxicity.scored(docs, model).select("doc_id", "toxic_score").collect() if r.doc_id in said and crc32(str(r.doc_id).encode()) % 5 == 0]
    return got


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = held_out_agreement(spark, docs.select("doc_id", "text"), labels)
    assert sum(y == 1 for y, _ in got) > 50
    caught = [s >= 0.5 for y, s in got if y == 1]
    wrong = [s >= 0.5 for y, s in got if y != 1]
    # the rest of the toxic rows hold none of the words that toxic rows share
    assert np.mean(caught) >= 0.88 and np.mean(wrong) <= 0.01


def test_query_and_passages(spark, sf_dir):
    rows = queries.op12_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    clean, bad = [f"plain{i % 7} word{i % 11} text{i % 5} " * 20 for i in range(60)], [f"plain{i % 7} word{i % 11} vileword hatefulword text{i % 5} " * 4 for i in range(60)]
    docs = spark.createDataFrame([(i, t, "old", "y", 1) for i, t in enumerate(clean + bad)], DOC)
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    more = [(1, "plain1 word1 " * 30 + "Vileword hatefulworded text1"), (2, None), (3, ""), (None, "vileword vileword hatefulword"), (4, "plain1 " * 50_000), (4, "plain1 " * 50_000), (5, "vilewords " * 3 + "vileword hatefulword " * 20_000)]
    got = toxicity.scored(spark.createDataFrame([(i, t, "old", "y", 1) for i, t in more], DOC), model)
    assert got.columns == ["doc_id", "text", "y", "n", "toxic_score", "toxic_passages"]
    found = got.collect()
    assert [r.toxic_score >= 0.5 for r in found] == [True, False, False, True, False, False, True]
    p = found[0].toxic_passages
    assert [more[0][1][a.start : a.end] for a in p] == ["Vileword hatefulworded"]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "old", "y", 1), (None, None, None, None, None)], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic_score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.toxic_score > 0.99 for r in toxicity.scored(docs, toxicity.train(docs, one)).collect())
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), one)).collect() == []
