"""Each training-data operator against a brute-force version, on small and on odd tables."""

import hashlib
import os
import re
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemeter.llm import bpe, html, packing, quality, queries, secrets, simhash, suffix, tokens, vectors
from tidemeter.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, rep string, g string"
ODD = [
    (1, "alpha beta gamma delta", "en", "s", 1, "x", "y", "z"),
    (2, "alpha beta gamma delta", "en", "s", 1, "x", "y", "z"),
    (2, "alpha beta gamma delta", "en", "s", 1, "x", "y", "z"),
    (3, "", None, None, None, None, None, None),
    (4, None, None, None, None, None, None, None),
    (None, "no id here at all", "en", "s", 1, "x", "y", "z"),
    (5, "long " * 30000 + "end", "en", "s", 1, "x", "y", "z"),
    (6, "ab" * 40, "en", "s", 1, "x", "y", "z"),
    (7, "pre " + "ab" * 40 + " é漢字🎉 <|endoftext|> x", "en", "s", 1, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(d):
    return (d is not None, d or 0)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, f, min(least[root(i)], default=None)) for i, (d, f) in enumerate(fps))


def found_components(df):
    return Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())


def test_simhash(docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_components(docs) == slow_components(rows)
    named = [r for r in ODD if r[0] is not None]
    assert found_components(odd.where("doc_id is not null")) == slow_components([r[:2] for r in named])
    assert len(simhash.near_duplicates(odd).collect()) == len(ODD)
    assert simhash.near_duplicates(none).count() == 0


def test_masks_cover_every_pair():
    m = simhash.masks()
    assert all(any(not x & (1 << a | 1 << b) for x in m) for a in range(64) for b in range(64))


def test_simhash_chain_of_near_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for _ in range(300):
        fps.append(fps[int(rng.integers(len(fps)))] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    rows = [(i, str(f)) for i, f in enumerate(fps)]
    monkeypatch.setattr(simhash, "fingerprints", lambda d, s: d.selectExpr("doc_id", "cast(text as long) fp"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(i, str(simhash.signed(int(f)))) for i, f in rows], "doc_id long, text string")).collect()}
    seen, want = {}, {}
    for i in range(len(fps)):
        if i in seen:
            continue
        todo, seen[i] = [i], i
        while todo:
            a = todo.pop()
            for b in range(len(fps)):
                if b not in seen and (fps[a] ^ fps[b]).bit_count() <= 2:
                    seen[b] = i
                    todo.append(b)
    want = seen
    assert got == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1002, 1001)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 201), 0), 1001: 1000, 1002: 1000}


def slow_suffix(rows, n=50):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        if d is not None:
            for i in range(len(t) - n + 1):
                w = t[i : i + n]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - n + 1):
                if first[t[i : i + n]] < d:
                    gone[i : i + n] = b"\1" * n
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(t), tuple(spans), bytes(c for c, g in zip(t, gone) if not g)))
    return Counter(out)


def found_suffix(df, **more):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffix.without_repeats(df, **more).collect())


def test_suffix(spark, docs, odd, none):
    assert found_suffix(docs, group_bytes=100_000) == slow_suffix([(r.doc_id, r.text) for r in docs.collect()])
    assert found_suffix(odd) == slow_suffix([r[:2] for r in ODD])
    assert suffix.without_repeats(none).count() == 0
    rng = np.random.default_rng(1)
    rows = []
    for d in range(60):
        part = "".join(rng.choice(list("ab"), 60)) if d % 3 else "a" * int(rng.integers(40, 400))
        rows.append((d, part + (rows[int(rng.integers(len(rows)))][1][int(rng.integers(0, 20)) :] if rows else "")))
    rows.append((99, "x" * 70_000 + "".join(rng.choice(list("abcdef"), 70_000)) + "x" * 60))
    rows.append((100, rows[-1][1][65_400:140_000]))
    assert found_suffix(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=5000) == slow_suffix(rows)


def test_suffix_with_hot_anchors(spark, monkeypatch):
    """A passage in most documents, each with surroundings of its own, in more regions than an anchor may have."""
    monkeypatch.setattr(suffix, "HOT_REGIONS", 2)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    hot = word(180)
    rows = [(d, word(int(rng.integers(0, 60))) + hot[int(rng.integers(0, 90)) :] + word(int(rng.integers(0, 60)))) for d in range(120)] + [(200 + d, word(100)) for d in range(20)]
    rows += [(300, rows[125][1]), (301, hot), (302, hot), (None, hot)]
    assert found_suffix(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=2000) == slow_suffix(rows)


@pytest.fixture(scope="module")
def one_anchor():
    """17000 documents that share 16 bytes, the anchor of all strings that hold it, each with surroundings of its own; some repeat parts of others."""
    rng = np.random.default_rng(3)
    letters = rng.choice(list(b"abcdefgh"), 4_000_000).astype(np.uint8).tobytes()
    key, first, count = suffix.anchors(letters[:2_000_000], np.array([2_000_000]))
    at = int(first[k := int(key.argmin())] + count[k] - 1)
    gram = letters[at : at + 16]
    around = letters[2_000_000:]
    rows = [(d, (around[80 * d : 80 * d + 40] + gram + around[80 * d + 40 : 80 * d + 80]).decode()) for d in range(17_000)]
    return rows + [(20_000 + d, rows[31 * d][1][d % 40 :] + "z" * (d % 7)) for d in range(500)]


@pytest.mark.parametrize("group_bytes", [4 << 20, 400_000])
def test_suffix_with_one_anchor_of_many_regions(spark, one_anchor, group_bytes):
    """At the shipped bound, in one group and over several."""
    assert found_suffix(spark.createDataFrame(one_anchor, "doc_id long, text string"), group_bytes=group_bytes) == slow_suffix(one_anchor)


def test_suffix_bounds_what_an_anchor_sends(one_anchor):
    group = suffix.Group(pd.DataFrame(one_anchor, columns=["doc_id", "text"]), suffix.LENGTH, 65)
    crowds = group.crowds()
    assert max(crowds.values()) > suffix.HOT_REGIONS
    told = {}
    for b, key, _ in group.keys():
        own, regions = suffix.unpack_keys(suffix.pack_keys(key, crowds))
        assert {k: n for k, n in zip(key.tolist(), regions.tolist(), strict=True) if n > 1} == {k: n for k, n in crowds.items() if k >> 32 == b}
        told[b] = np.packbits(np.concatenate([np.isin(own, k) for k in suffix.shared_and_hot([(own, regions)])])).tobytes()
    for bits, hot in ((told, True), ({}, False)):
        held, _ = group.regions(bits)
        size = Counter()
        for b, h in held.items():
            for region, (_, _, anchor) in h.items():
                size[b, anchor] += len(region)
        assert (max(size.values()) <= suffix.HOT_REGIONS * (2 * suffix.LENGTH - suffix.GRAM)) is hot


@pytest.mark.parametrize("length", [32, 50, 64, 79])
def test_suffix_sorts_only_strings_that_recur(length):
    """What equals nothing leaves before the sort, as most strings of a bucket do; what recurs stays, and is found as by comparing all."""
    rng = np.random.default_rng(7)
    text = rng.integers(97, 100, 60_000, dtype=np.uint8)
    text[50_000:50_300] = text[10_000:10_300]
    text[55_000:55_200] = text[10_100:10_300]
    starts = np.arange(0, len(text) - length + 1)
    left = suffix.recurring(text, starts, length)
    raw = text.tobytes()
    times = Counter(raw[a : a + length] for a in starts.tolist())
    again = {a for a in starts.tolist() if times[raw[a : a + length]] > 1}
    assert again <= {*left.tolist()} and len(left) < len(starts) // 4
    own: dict = {}
    for k, (at, group) in enumerate(suffix.suffix_classes(text, starts, length)):
        begin = np.cumsum(np.append(True, group[1:] != group[:-1]))
        for a, b in zip(at.tolist(), begin.tolist(), strict=True):
            own.setdefault((k, b), []).append(a)
    assert {a for x in own.values() for a in x} == again
    assert all(len({raw[a : a + length] for a in x}) == 1 for x in own.values()) and len(own) == len({raw[a : a + length] for a in again})


def test_suffix_classes_by_cover():
    s = suffix.shifts()
    assert all((i + s[i, j]) % 16 in suffix.COVER and (j + s[i, j]) % 16 in suffix.COVER for i in range(16) for j in range(16))


def ints(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_tokens_round_trip(spark, docs, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, odd, none):
        to = tokens.scratch(spark, "t")
        tokens.write_tokens(df, to, path, end_id=2, segment_ids=5000)
        got = sorted(((r.doc_id, r.start, r.n_tokens, tuple(ints(r.ids))) for r in tokens.read_tokens(spark.read.parquet(to)).collect()), key=lambda r: (key(r[0]), r[1]))
        rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (key(r[0]), r[1] is not None, r[1] or ""))
        want, at = [], 0
        for d, t in rows:
            ids = (*library.encode(t or "", add_special_tokens=False).ids, 2)
            want.append((d, at, len(ids), ids))
            at += len(ids)
        assert got == want


def test_elias_fano_select():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (1000, 50), (3000, 10**9), (700, 700)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        raw = b"x" + tokens.elias_fano(v)
        e = tokens.EliasFano(raw, 1)
        assert e.end == len(raw) and e.between(0, n).tolist() == v.tolist()
        assert all(e.between(a, b).tolist() == v[a:b].tolist() for a, b in np.sort(rng.integers(0, n + 1, (40, 2)), axis=1))
        assert [e.select(i) for i in range(n)] == v.tolist()
    assert len(tokens.elias_fano(np.arange(0, 10**7, 1000, dtype=np.uint64))) < 10**4 * 2


def test_segment_is_checked():
    raw = tokens.write_segment([None, 3, 9], [b"\1\0\0\0", b"", b"\2\0\0\0\3\0\1\0"])
    s = tokens.read_segment(raw)
    assert (s.documents(0, 3), s.bounds(0, 3).tolist(), s.ids.tolist()) == ([None, 3, 9], [0, 1, 1, 3], [1, 2, 65539])
    assert (s.documents(1, 3), s.bounds(1, 3).tolist(), [s.tokens(i).tolist() for i in range(3)]) == ([3, 9], [1, 1, 3], [[1], [], [2, 65539]])
    with pytest.raises(ValueError):
        tokens.read_segment(raw[:-1] + b"?")


def test_bpe(docs, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for df in (docs, odd):
        got = Counter((r.doc_id, tuple(ints(r.ids)), r.decoded) for r in bpe.encoded(df, path).collect())
        want = Counter()
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
        assert got == want
    assert bpe.encoded(none, path).count() == 0
    model, rng = bpe.bpe(path), np.random.default_rng(2)
    for _ in range(2000):
        text = "".join(rng.choice(list("aeiounthrs'.,!<|>09éÀñ\n\tΣσßЖ漢🎉 "), int(rng.integers(1, 30))))
        assert ints(model.encode(text)) == library.encode(text, add_special_tokens=False).ids, text


def test_suffix_automaton_lists_every_token():
    rng = np.random.default_rng(12)
    for _ in range(60):
        words = {"".join(rng.choice(list("abc"), int(rng.integers(1, 6)))): k for k in range(int(rng.integers(1, 40)))}
        text = "".join(rng.choice(list("abcd"), 60))
        want = [(i, n, words[text[i + 1 - n : i + 1]]) for i in range(60) for n in range(6, 0, -1) if i + 1 >= n and text[i + 1 - n : i + 1] in words]
        assert [*bpe.SuffixAutomaton(words).matches(text)] == want


def check_packing(placed, rows, capacity):
    assert Counter((r.doc_id, r.piece, r.length) for r in placed) == Counter(rows)
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, odd, none):
    path = queries.tokenizer("byte_bpe_50k.json")
    for df in (docs, odd):
        pieces = packing.token_pieces(df, path).collect()
        assert all(0 < r.length <= 2048 and len(r.ids) == 4 * r.length and (r.piece == 0 or r.length == 2048) for r in pieces)
        whole = defaultdict(list)
        for r in sorted(pieces, key=lambda r: r.piece):
            whole[r.doc_id].append(r)
        assert all(sum(x.length for x in v[:-1]) == v[-1].start for k, v in whole.items() if k not in (2,))
        placed = packing.pack(packing.token_pieces(df, path).drop("ids")).collect()
        n = check_packing(placed, [(r.doc_id, r.piece, r.length) for r in pieces], 2048)
        assert n <= 1.02 * -(-sum(r.length for r in pieces) // 2048) + 1
    assert packing.pack(packing.token_pieces(none, path)).count() == 0
    same = spark.range(1000).selectExpr("id doc_id", "cast(0 as int) piece", "cast(0 as long) start", "cast(3 + id % 2 * 4 as long) length", "'x' sequence_id", "1 offset")
    assert check_packing(packing.pack(same, 10).collect(), [(i, 0, 3 + i % 2 * 4) for i in range(1000)], 10) == 500


def slow_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return sorted(rooms)


def test_best_fit_is_that_of_single_pieces():
    rng = np.random.default_rng(11)
    for _ in range(200):
        sizes = rng.integers(1, 30, int(rng.integers(0, 60))).tolist()
        made = packing.best_fit(packing._Left(dict(Counter(sizes))), 30)
        assert sorted(30 - sum(p) for p, n in made for _ in range(n)) == slow_best_fit(sizes, 30)
        assert Counter(s for p, n in made for s in p * n) == Counter(sizes)


def fewest(sizes, capacity):
    sizes = tuple(sorted(sizes, reverse=True))
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[k]:
                new = list(rooms)
                new.remove(r)
                go(k + 1, [*new, r - sizes[k]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(8)
    for _ in range(150):
        sizes = rng.integers(1, 21, int(rng.integers(1, 9))).tolist()
        left = packing._Left(dict(Counter(sizes)))
        fixed = packing.reduce_dominated(left, 20)
        rest = [s for s, n in left.count.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20), sizes
        assert Counter(s for p, n in packing.plan(dict(Counter(sizes)), 20) for s in p * n) == Counter(sizes)


VEC = "vec_id long, embedding array<float>, label int"
VECTORS = [(i, [float((i * 7 + j * 3) % 11 - 5) / 4 for j in range(4)], 0) for i in range(120)]
VECTORS += [(200 + i, [1.0, 0.5, -0.25, 0.125], 1) for i in range(90)]
VECTORS += [(1000, None, 0), (1050, [1.0, None, 2.0, 0.0], 0), (1100, [float("nan"), 1.0, 1.0, 1.0], 0), (1150, [float("inf"), 0.0, 0.0, 0.0], 0), (1200, [0.0] * 4, 0), (1250, [1.0, 2.0], 0), (None, [1.0] * 4, 0), (0, VECTORS[0][1], 0)]


def slow_top(rows, every, k, product, zero=True):
    ok = {(i, tuple(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}
    out = []
    for q, a in ok:
        if q % every == 0:
            got = sorted((-product(a, b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(got)]
    return Counter(out)


def test_topk(spark):
    df = spark.createDataFrame(VECTORS, VEC)
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    want = slow_top(VECTORS, 50, 5, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b))))
    for block in (8192, 40):
        got = vectors.top_k(df, df.where("vec_id % 50 = 0"), block=block, query_block=3).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert vectors.top_k(df.limit(0), df.limit(0)).count() == 0


def test_threshold_search_stops_early():
    rng = np.random.default_rng(1)
    block = rng.normal(size=(4000, 8))
    block[:50] *= 9
    order = np.argsort(block, axis=0).astype(np.int32)
    for q in rng.normal(size=(20, 8)):
        rows, scores, met = vectors.threshold_search(q, block, order, 5)
        assert rows.tolist() == np.argsort(-(block @ q))[:5].tolist() and np.allclose(scores, (block @ q)[rows])


def test_ann(spark, sf_dir):
    df = spark.createDataFrame(VECTORS, VEC)
    got = vectors.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    want = slow_top(VECTORS, 20, 20, lambda a, b: float(np.dot(a, b)), zero=False)
    assert Counter(r.query_id for r in got) == Counter(q for q, *_ in want.elements())
    assert vectors.nearest(df.limit(0), df.limit(0)).count() == 0
    again = vectors.nearest(df, df.where("vec_id % 20 = 0"), k=20, chunk=10, query_chunk=2).collect()  # blocks in parts
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in own.collect()]
    want = {(q, i) for q, _, i, _ in slow_top(rows, 20, 20, lambda a, b: float(np.dot(a, b)), zero=False)}
    got = vectors.nearest(own, own.where("vec_id % 20 = 0")).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    at = {i: np.array(v, float) for i, v, _ in rows}
    assert all(abs(r.score - float(at[r.query_id] @ at[r.vec_id])) < 1e-12 for r in got)


def slow_base(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark, docs, odd, none, sf_dir):
    more = spark.createDataFrame([(50, 'é password = "hunter2hunter" AKIA' + "Z9" * 8 + " " + "0af" * 12, "", "", 0, "", "", ""), (51, "TOKEN:short api_key='longenough1'", "", "", 0, "", "", "")], DOC)
    for df in (docs.select("doc_id", "text"), odd.unionByName(more)):
        for r in secrets.scanned(df).collect():
            assert [(s.kind, s.start, s.end) for s in r.secret_spans if s.kind != "literal"] == slow_base(r.text)
    assert secrets.scanned(none).count() == 0
    got = {r.doc_id: r for r in queries.op2_secrets(spark, sf_dir).collect()}
    for r in docs.collect():
        base = slow_base(r.text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]


@pytest.mark.parametrize(
    "text, literals",
    [
        ('KEY = "abcD1234"\ndb_pass = KEY + "zzQ9!x"', ["abcD1234", "zzQ9!x"]),
        ('{"client-secret-key": "Zx81kQp0rT"}', ["Zx81kQp0rT"]),
        ("<accessKey>q8W3e0R5tY</accessKey>", ["q8W3e0R5tY"]),
        ("export DB_PWD=Tr0ub4dor&3x", ["Tr0ub4dor&3x"]),
        ("pwd: ${DB_PWD}", []),
        ('password_file = "/etc/shadow0"', []),
        ('passphrase = "changeme123"', []),
        ('credential: "two words here"', []),
        ("The author said: nothing", []),
    ],
)
def test_secret_literals(text, literals):
    assert [text[a:b] for a, k, b in secrets.scan(text) if k == "literal"] == literals


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "a token=abcdefgh12345 b", 5), (2, None, 1)], "doc_id long, text string, n_chars long")
    assert [r.text for r in secrets.redacted(df).orderBy("doc_id").collect()] == ["a [SECRET] b", None]
    assert secrets.redacted(odd).count() == len(ODD)


def test_quality(spark, sf_dir, odd, none):
    wide = sf_dir.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{wide}/labels.parquet").collect()}
    rows = queries.op4_quality(spark, wide).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in own) >= 0.95 * len(own)
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, lab)
    assert len(quality.scored(odd, model).collect()) == len(ODD)
    assert quality.scored(none, quality.train(none, lab.limit(0))).count() == 0
    assert quality.score(quality.fit([]), *quality.features(None)) == 0.5


def test_quality_pair_sum_is_linear_time_identity():
    rng = np.random.default_rng(0)
    at, x = np.array([1, 5, 9]), rng.normal(size=3)
    model = {"w0": 0.3, "w": rng.normal(size=12), "v": rng.normal(size=(12, 4))}
    z = 0.3 + model["w"][at] @ x + sum(model["v"][at[i]] @ model["v"][at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(quality.score(model, at, x) - 1 / (1 + np.exp(-z))) < 1e-12


def test_html(spark, sf_dir):
    rows = queries.op9_html(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    page = lambda body: f"<html><head><title>t</title></head><body><div class=top>Site&nbsp;A &amp; B</div>{body}<p>All rights</p></body></html>"
    table = [
        (1, "http://h.org/a/1", page("<p>One  <b>bold</b>\nline</p><p>Two<br>halves"), "k"),
        (2, "https://h.org/a/2?x=1", page("<p>Other</p>"), "k"),
        (3, None, page("<p>alone</p>"), "k"),
        (4, "http://other.org/", None, "k"),
        (5, "http://h.org/b", "<article><h1>T</h1><p>All rights</p><form>f</form><div class='comments'><p>c</p></div></article>", "k"),
        (5, "http://h.org/b", "<article><h1>T</h1><p>All rights</p><form>f</form><div class='comments'><p>c</p></div></article>", "k"),
        (6, "http://h.org/c", "", "k"),
    ]
    df = spark.createDataFrame(table, "page_id long, url string, html string, key string")
    got = Counter((r.page_id, r.text) for r in html.extracted(df).collect())
    assert got == Counter({(1, "One bold line\n\nTwo halves"): 1, (2, "Other"): 1, (3, "Site A & B\n\nalone\n\nAll rights"): 1, (4, ""): 1, (5, "T\n\nAll rights"): 2, (6, ""): 1})
    assert html.extracted(df.limit(0)).count() == 0


def test_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 6, int(rng.integers(0, 14))).tolist() for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        got, rest = html.common(a, b), iter(b)
        assert len(got) == best[-1, -1] and all(x in rest for x in (a[i] for i in got))


def test_common_lines_of_long_pages_by_halves(monkeypatch):
    rng = np.random.default_rng(6)
    whole = [(rng.integers(0, 9, int(rng.integers(0, 40))).tolist(), rng.integers(0, 9, int(rng.integers(0, 40))).tolist()) for _ in range(100)]
    want = [len(html.common(a, b)) for a, b in whole]
    monkeypatch.setattr(html, "CELLS", 20)
    for (a, b), n in zip(whole, want):
        got, rest = html.common(a, b), iter(b)
        assert len(got) == n and all(x in rest for x in (a[i] for i in got))
    a = list(range(5000))
    assert html._counts(a, a)[-1] == 5000 and html._counts(a[:10], a)[20] == 10


def slow_main(rows):
    """Unmarked pages of distinct lines in one order: every class of equal pages loses what the nearest other class shares."""
    own = {i: [t for t, z in html.lines(h)] for i, u, h in rows}
    path = {}
    for i, u, _ in rows:
        path.setdefault(tuple(own[i]), set()).add(u.split("?")[0].removeprefix("http://h.org"))
    order = sorted((min(p), html.class_of([html.line_hash(t) for t in c]), c) for c, p in path.items())
    out = Counter()
    for i, _, _ in rows:
        k = next(k for k, x in enumerate(order) if x[2] == tuple(own[i]))
        near = [(len(os.path.commonprefix([order[k][0], order[j][0]])), -j, j) for j in (k - 1, k + 1) if 0 <= j < len(order)]
        shared = set(order[max(near)[2]][2]) if near else set()
        out[i, "\n\n".join([t for t in own[i] if t not in shared] or own[i])] += 1
    return out


def test_html_differencing(spark):
    rng = np.random.default_rng(9)
    top, foot = [f"top {i}" for i in range(4)], [f"foot {i}" for i in range(3)]
    rows = []
    for i in range(40):
        body = [f"text {i} {j}" for j in range(int(rng.integers(1, 6)))]
        kept = [t for t in [*top, *body, *foot] if t in body or rng.random() < 0.8]
        rows.append((i, f"http://h.org/{'ab'[i % 2]}/{int(rng.integers(9))}/{i}?s={i}", "".join(f"<p>{t}</p>" for t in kept)))
    # copies of a page: as another page, as a row, and by a query string alone
    rows += [(100, "http://h.org/a/copy", rows[3][2]), rows[5], (101, rows[7][1] + "&page=2", rows[7][2])]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert Counter((r.page_id, r.text) for r in got.collect()) == slow_main(rows)


def test_html_differences_marked_pages_too(spark, monkeypatch):
    """Every page goes through differencing; the article's mark is a check of what it found, and equal pages of a class are dealt over tasks."""
    page = lambda own, tag: f"<html><body><p>Site A</p><{tag}><p>{own} one</p><p>Licence</p></{tag}><p>Bye</p></body></html>"
    rows = [(i, f"http://h/a/{i}", page(f"page {i}", "article")) for i in range(3)] + [(i, f"http://g/a/{i}", page(f"page {i}", "div")) for i in (3, 4)]
    rows += [(i, f"http://c/a/{i}", page("equal", "article")) for i in range(5, 25)] + [(25, "http://c/b", page("other", "article")), (26, None, page("alone", "article")), (27, "http://h/z", None)]
    monkeypatch.setattr(html, "CLASS_PAGES", 4)
    got = {r.page_id: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {*got} == {*range(28)}
    for i in (0, 1, 2, *range(5, 26)):
        own = "equal" if 5 <= i < 25 else "other" if i == 25 else f"page {i}"
        # the pair shares the site's lines and the licence, which the mark brings back
        assert (got[i].text, got[i].n_lines, got[i].n_shared, got[i].n_restored) == (f"{own} one\n\nLicence", 4, 3, 1), got[i]
    for i in (3, 4):
        assert (got[i].text, got[i].n_shared, got[i].n_restored) == (f"page {i} one", 3, 0)
    assert (got[26].text, got[26].n_shared) == ("alone one\n\nLicence", 0) and (got[27].text, got[27].n_lines) == ("", 0)


def test_html_reads_broken_pages_once():
    for part in ("<a ", "<script ", "<!--", "<a '", '<a "', "<![CDATA[", "</", "<p x='\">", "&amp", "<script>"):
        begun = time.time()
        html.lines(part * (1_000_000 // len(part)))
        assert time.time() - begun < 8, part
    assert html.lines("<p>one <b>two</b><script>x</script> three<p>four <a href='x'") == [("one two three", 1), ("four", 1)]
    assert html.lines("a <script>if (1 > 0) x") == [("a", 1)] and html.lines("1 < 2 and 3 > 2") == [("1 < 2 and 3 > 2", 1)]


def slow_lines(page):
    """(text, zone) as html.lines of pages of whole tags, by looking through the open elements each time."""
    out, stack, held = [], [], []

    def flush(zone):
        if text := " ".join("".join(held).split()):
            out.append((text, zone))
        held.clear()

    zone = html.NEUTRAL
    for end, tag, text in re.findall(r"<(/?)(\w+)>|([^<]+)", page):
        if text:
            held.append(text)
            continue
        if tag in html.BLOCKS:
            flush(zone)
        if end:
            if tag in stack:
                while stack.pop() != tag:
                    pass
        else:
            if tag in ("p", "li"):
                near = [t for t in stack if t in html.HOLDERS or t == tag][-1:]
                if near == [tag]:
                    while stack.pop() != tag:
                        pass
            stack.append(tag)
        if tag in html.BLOCKS:
            zone = html.DROPPED if {*stack} & html.OUTSIDE else html.MAIN if {*stack} & {"article", "main"} else html.NEUTRAL
    flush(zone)
    return out


def test_html_lines_by_looking_through_the_stack():
    rng = np.random.default_rng(2)
    tags = ["p", "li", "ul", "b", "i", "div", "nav", "footer", "section", "td", "span"]
    for _ in range(400):
        page = "".join(f"<{rng.choice(['', '', '/'])}{rng.choice(tags)}>" if rng.random() < 0.6 else f"w{k} " for k in range(40))
        if rng.random() < 0.5:
            page = "<article>" + page
        assert html.lines(page) == slow_lines(page), page


def test_html_of_a_megabyte_of_nested_and_unmatched_tags():
    for page in ("<div>" * 200_000, "<b>" * 150_000 + "</i>" * 150_000, "<b>" * 100_000 + "<p></p>" * 100_000, "<b><p>" * 170_000, "<ul><li>" * 120_000, "<div><span>" * 60_000 + "</div>" * 60_000):
        began = time.time()
        assert html.lines(page + "end")[-1][0] == "end"
        assert time.time() - began < 8


def test_ann_is_exact_where_no_number_of_probes_is_enough(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_PROBES", 2)
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in own.collect()]
    got = defaultdict(list)
    for r in vectors.nearest(own, own.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for i, x in rows:
        if i % 20 == 0:
            assert got[i] == [j for _, j in sorted((-float(x @ y), j) for j, y in rows if j != i)[:20]]


def test_ann_of_a_large_table_takes_the_rotations_for_which_probes_are_enough(spark, sf_dir):
    # at this count three rotations were taken, for which 2048 probes are too few, and all queries were searched exactly
    assert vectors.levels_for(615384, 64) == 3
    own = vectors.classes(vectors.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "array<float>"), 21)
    folded = own.select(F.element_at("ids", 1).alias("c"), F.size("vector").alias("d"), "vector")
    fit, _ = vectors.fitted(folded, folded.where("c % 20 = 0").withColumnRenamed("c", "q"), 20, vectors.TABLES, {64: 615384})
    levels, probes = fit[64]
    assert levels == 2 and probes <= vectors.MOST_PROBES


def test_ann_searches_again_where_the_first_score_to_beat_is_too_high(spark, sf_dir, monkeypatch):
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    real = vectors.fitted
    monkeypatch.setattr(vectors, "fitted", lambda *a: (real(*a)[0], {64: 0.9}))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in own.collect()]
    got = defaultdict(list)
    for r in vectors.nearest(own, own.where("vec_id % 20 = 0"), k=20, query_chunk=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for i, x in rows:
        if i % 20 == 0:
            assert got[i] == [j for _, j in sorted((-float(x @ y), j) for j, y in rows if j != i)[:20]]


def test_ann_products_of_small_and_large_buckets(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(vectors, "PRODUCTS", 500)
    for few, whole in ((1, False), (256, False), (10**9, False), (256, True)):
        monkeypatch.setattr(vectors, "FEW_PRODUCTS", few)
        x, ask = rng.integers(-2, 3, (300, 4)).astype(float), rng.normal(size=(40, 4))
        ask[:20] = rng.integers(-2, 3, (20, 4))  # many equal products
        code, least = rng.choice([1, 1, 1, 2, 3, 5], 300), [None if i % 3 else 1.0 for i in range(40)]
        looks = [[] if whole and i % 2 else sorted(rng.choice(7, 3, replace=False).tolist()) for i in range(40)]
        rows = pa.table({"code": code, "c": np.arange(300), "low": np.arange(300) * 7 % 300, "vector": pa.array(list(x), pa.list_(pa.float64()))})
        asks = pa.table({"q": np.arange(40), "least": pa.array(least, pa.float64()), "vector": pa.array(list(ask), pa.list_(pa.float64())), "codes": pa.array(looks, pa.list_(pa.int64()))})
        got = defaultdict(list)
        for r in vectors.products(asks, rows, 5).to_pylist():
            got[r["q"]].append((-r["score"], r["low"], r["c"]))
        for i in range(40):
            can = [(-float(np.einsum("j,j->", ask[i], x[j])), j * 7 % 300, j) for j in range(300) if not looks[i] or code[j] in looks[i]]
            want = sorted(z for z in can if least[i] is None or -z[0] >= 1.0)[:6]
            assert [z[2] for z in sorted(got[i])] == [z[2] for z in want]
            assert np.allclose([z[0] for z in sorted(got[i])], [z[0] for z in want])
