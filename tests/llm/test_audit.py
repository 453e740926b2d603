"""Filter interactions against plain removal in every order."""

import random
import re
from itertools import permutations

import duckdb

from tidemeter.llm import audit, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, fails string, part string"


def slow_fails(rows):
    out, first = [], {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((source or "", i, {
            k for k, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if bad
        }))
    return out


def slow_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails, out = slow_fails(rows), {}
    for part in {p for p, *_ in fails}:
        own, share = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone, stay = [f for f in left if k in f[2]], [f for f in left if k not in f[2]]
                share[k] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(k in f[2] for f in own) - len(gone), sum(f[2] == {k} for f in own), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)]
                left = stay
        for (p, order, step), held in out.items():
            if p == part:
                held.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    df = queries.op11_audit(spark, sf_dir)
    assert found(df) == slow_audit(rows, labels)
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        sql = db.sql(queries.oracle_sql()["op11_audit"])
        assert sorted(map(tuple, sql.select(*df.columns).fetchall())) == sorted(tuple(r) for r in df.collect())


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "x", "a"), (3, "x", "a"), (3, "x", "b"), (None, "x", None), (None, None, ""), (9, "", None), (10, None, "a"), (11, "\x0b \t", "a"), (12, many, "a"), (13, many, "b"), (14, "A B # " * 9000, "a"), (15, many + "\xa0é漢 A$", None), (12, "other", "b"), (16, "  " + many + "\n", "a")]
    labels = [(12, 1, None), (12, 0, 1), (13, None, 1), (14, 0, 0), (None, 1, 1), (99, 1, 1), (3, 1, 0)]
    df = spark.createDataFrame([(i, t, "en", s, 1, "x", "y") for i, t, s in rows], DOC)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(audit.audit(audit.failures(df, said))) == slow_audit(rows, labels)
    assert audit.audit(audit.failures(df.limit(0), said)).collect() == []
    none = found(audit.audit(audit.failures(df, said.limit(0))))
    assert {v[4:6] for v in none.values()} == {(0, 0)}


def test_potentials_give_shapley_values():
    rng = random.Random(3)
    for _ in range(20):
        worth = [0] + [rng.randint(0, 1000) for _ in range(31)]
        plain = [0] * 5
        for order in permutations(range(5)):
            before = 0
            for k in order:
                plain[k] += worth[before | 1 << k] - worth[before]
                before |= 1 << k
        assert audit.shapley(worth) == plain
