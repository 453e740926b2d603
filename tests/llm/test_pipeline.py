"""The pipeline and each of its stages against plain versions, on small and on odd tables."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemeter.llm import quality, queries

from .test_near import replaced, slow_kept
from .test_operators import ODD, check_packing, slow_base, slow_suffix

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def corpus():
    """Clean prose with exact and near copies, shared passages, secrets, repeated ids and nulls, and junk."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    junk = lambda n: "||".join(rng.choice(list("#$%&@!"), n)) + " 0 1 2 " * n
    rows, passage = [], prose(70)
    for d in range(0, 120, 2):
        text = " ".join(prose(int(rng.integers(8, 15))) for _ in range(8))
        rows.append((d, text if d % 8 else f"{text[: len(text) // 2]} {passage} {text[len(text) // 2 :]} é漢字 token=abcdEFGH1234{d} end"))
    rows += [(1000 + d, rows[d][1]) for d in range(5)] + [(1100 + d, " ".join(replaced(rng, rows[10 + d][1].split(" "), 2))) for d in range(5)]
    rows += [(2000 + d, junk(int(rng.integers(5, 30)))) for d in range(60)]
    rows += [rows[3], (4, prose(60)), (3000, None), (3001, ""), (None, prose(50))]
    labels = [(d, int(d < 2000), 0) for d, _ in rows if d is not None and d < 3000]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (rows, labels) = tmp_path_factory.mktemp("corpus"), corpus()
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{path}/labels.parquet")
    return str(path)


def slow_run(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if quality.score(model, *quality.features(r.text)) >= 0.7]
    assert all(d is None or d < 2000 or d >= 3000 for d, _ in rows) and sum(d is not None and d < 120 for d, _ in rows) == 62
    rows = slow_kept(rows)
    rows = [(d, kept.decode("utf-8", "ignore")) for (d, _, _, kept), n in slow_suffix(rows).items() for _ in range(n)]
    return [(d, "".join(without(t))) for d, t in rows]


def without(text):
    at = 0
    for _, a, b in slow_base(text):
        yield text[at:a] + "[SECRET]"
        at = b
    yield text[at:]


def pieces(texts):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json")), []
    for d, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        first = n % 2048 or 2048
        out += [(d, i, first if i == 0 else 2048) for i in range(-(-n // 2048))]
    return out


def test_run(spark, folder):
    placed = corpus_pipeline.run(spark, folder).collect()
    want = slow_run(spark, folder)
    assert len(want) < 62 + 12
    check_packing(placed, pieces(want), 2048)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, folder, name, stage):
    odd = spark.createDataFrame([(*r[:5], "x", 1, 2) for r in ODD], DOC + ", keys string, spans long, sequence_id long")
    got = stage(spark, odd, folder)
    if name == "best_fit_packing":
        check_packing(got.collect(), pieces([r[:2] for r in ODD]), 2048)
    else:
        assert got.columns == odd.columns
        kept = Counter((r.doc_id, r.text) for r in got.collect())
        if name == "secret_scan":
            assert kept == Counter((r[0], r[1] and "".join(without(r[1]))) for r in ODD)
        if name == "simhash_near_dedup":
            assert kept == Counter(slow_kept([r[:2] for r in ODD]))
        if name == "suffix_array_dedup":
            assert kept == Counter((d, k.decode("utf-8", "ignore")) for (d, _, _, k), n in slow_suffix([r[:2] for r in ODD]).items() for _ in range(n))
    assert stage(spark, odd.limit(0), folder).count() == 0


def test_no_labels(spark, folder, tmp_path):
    spark.createDataFrame([], LABEL).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # nothing is known of any document: every score is 0.5, below what stays
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == 0
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[0][0])
