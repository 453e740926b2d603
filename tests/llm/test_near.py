"""Near copies of the pipeline's stage against brute force."""

import numpy as np

import corpus_pipeline
from tidemeter.llm import near

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_kept(rows):
    named = [r for r in rows if r[0] is not None]
    group = list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            if group[i] != group[j] and likeness(named[i][1], named[j][1]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, r in zip(group, named, strict=True):
        least[g] = min(least.get(g, r), r, key=lambda r: (r[0], r[1] is None, r[1] or ""))
    return sorted([*least.values(), *[r for r in rows if r[0] is None]], key=repr)


def kept(spark, rows):
    return sorted([(r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC), "").collect()], key=repr)


def replaced(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"n{rng.integers(1 << 40)}"
    return out


def test_near_copies_with_changed_words_go(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(60, 300)))]
        rows.append((10 * k, " ".join(words)))
        rows += [(10 * k + i, " ".join(replaced(rng, words, int(rng.integers(1, 6))))) for i in (1, 2, 3)]
    rows += [(9000, None), (9001, ""), (9002, " "), (None, rows[0][1]), (None, None), (9003, "Short text"), (9004, "short  TEXT"), (9005, "short texts")]
    assert kept(spark, rows) == slow_kept(rows)
    assert kept(spark, []) == []


def test_rows_of_one_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (3, a + " more"), (7, b), (8, None), (8, c)]
    assert kept(spark, rows) == slow_kept(rows) == sorted([(3, a + " more"), (5, b), (8, None), (8, c)], key=repr)


def test_pairs_apart_from_a_bucket_s_pivot_are_compared(spark, monkeypatch):
    """All texts in one bucket of either step: links that do not touch its pivot count too."""
    monkeypatch.setattr(near, "bucket_keys", lambda hashes, own: [1] if len(own) else [])
    monkeypatch.setattr(near, "narrow_keys", lambda own: [1] if len(own) else [])
    rng = np.random.default_rng(4)
    base = [[f"{x}{i}" for i in range(100)] for x in "abcd"]
    rows = [(10 * k + i, " ".join(replaced(rng, w, i % 2))) for k, w in enumerate(base) for i in range(4)]
    assert kept(spark, rows) == slow_kept(rows)
    monkeypatch.setattr(near, "BLOCK", 5)
    assert kept(spark, rows) == slow_kept(rows)


def test_edits_of_one_original_below_the_similarity_to_each_other(spark):
    """A large group whose texts mostly link through the original alone, some not at all."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))] + [(k, " ".join(replaced(rng, base, 2 + k % 6))) for k in range(150)]
    assert kept(spark, rows) == slow_kept(rows)


def test_repeated_rows_and_clashing_columns(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, a, 1, 2), (1, a, 1, 2), (1, a.upper(), 0, 3), (2, b, 5, 6), (2, None, 5, 6)]
    got = near.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, root int, t int"))
    # the id's two texts are one set of shingles: the first row stays; a null text has no words, and so is a set of its own
    assert sorted(got.collect(), key=repr) == sorted([(1, a.upper(), 0, 3), (2, b, 5, 6), (2, None, 5, 6)], key=repr)


def test_pairs_of_a_block_that_share_rare_shingles():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    for case in range(12):
        sets, common = [], rng.integers(0, 1 << 32, 400, dtype=np.uint32)
        for _ in range(12):
            base = np.unique(np.concatenate([rng.choice(common, 20 + 5 * case), rng.integers(0, 1 << 32, 40, dtype=np.uint32)]))
            for _ in range(4):
                keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.2])]
                sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 32, rng.integers(0, 6), dtype=np.uint32)])))
        n = len(sets)
        matrix = near.sharing(sets)
        alike = [(x, y) for x in range(n) for y in range(x) if near.jaccard(sets[x], sets[y]) >= near.SIMILAR]
        assert alike and all(matrix[x, y] for x, y in alike)
        roots, blocks = [k // 3 for k in range(n)], [k % 2 for k in range(n)]
        for i, j in ((0, 0), (0, 1)):
            table = pa.table({"_set": pa.array(range(n), pa.int64()), "root": pa.array(roots, pa.int64()), "b": blocks, "i": [i] * n, "j": [j] * n, "grams": [s.astype("<u4").tobytes() for s in sets]})
            links = {*zip(*(near.joined(table).column(c).to_pylist() for c in ("a", "b")), strict=True)}
            may = [(x, y) for x, y in alike if roots[x] != roots[y] and (i == j or blocks[x] != blocks[y])]
            assert links <= {*may}

            def groups(pairs):
                up = {r: r for r in roots}

                def top(r):
                    return r if up[r] == r else top(up[r])

                for x, y in pairs:
                    up[top(roots[x])] = top(roots[y])
                return {frozenset(r for r in up if top(r) == t) for t in map(top, up)}

            assert groups(links) == groups(may)


def test_full_blocks_of_unlike_sets_are_fast():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 32, 150, dtype=np.uint32)
    # half of each set's shingles are shared by all: alike, and below the similarity
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 32, 150, dtype=np.uint32)])) for _ in range(1024)]
    table = pa.table({"_set": pa.array(range(1024), pa.int64()), "root": pa.array(range(1024), pa.int64()), "b": [0] * 1024, "i": [0] * 1024, "j": [0] * 1024, "grams": [s.astype("<u4").tobytes() for s in sets]})
    began = time.time()
    assert near.joined(table).num_rows == 0
    assert time.time() - began < 2
