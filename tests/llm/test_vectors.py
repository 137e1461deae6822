import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import clustering as C
from strandloom.llm import queries as Q
from strandloom.llm import whitening as W

VECTORS = "vec_id long, embedding array<float>, label int, n int, vector int, cluster int, whitened int"


def _table(spark, path, rows):
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


# ---- whitening


def test_remainders_give_the_exact_product():
    rng = np.random.default_rng(0)
    for most in (3, 10**6, 10**12):
        x = rng.integers(-most, most + 1, (9000, 4))
        primes = W.primes_for(len(x) * most**2)
        assert all(all(p % q for q in range(2, int(p**0.5) + 1)) for p in primes) and len(set(primes)) == len(primes)
        o = x.astype(object)
        assert (W.from_remainders(W.remainders(x, primes)) == o.T @ o).all()


def test_moments_of_parts_are_those_of_all():
    x = np.random.default_rng(1).normal(3, 2, (50, 3))
    total = (0.0, np.zeros(3), np.zeros((3, 3)))
    for part in (x[:0], x[:1], x[1:20], x[20:]):
        m = part.mean(axis=0) if len(part) else np.zeros(3)
        total = W.merged(total, (float(len(part)), m, (part - m).T @ (part - m)))
    assert total[0] == 50 and np.allclose(total[1], x.mean(axis=0)) and np.allclose(total[2] / 50, np.cov(x.T, bias=True))


def _whitened(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.component):
        out[r.vec_id].append(r.whitened)
    return out


def test_whitening_equals_brute_force(spark, data):
    rows = Q.op11_embedding_whitening(spark, f"{data}/sf0.001").collect()
    table = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{data}/sf0.001/embeddings.parquet') ORDER BY 1").fetchall()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in e] for _, e in table], object)
    n, s = len(x), x.sum(axis=0)
    exact = dict(zip([i for i, _ in table], ((n * x - s) ** 2).sum(axis=1), strict=True))
    assert len(rows) == 32 * n and all(r.n == n and r.deviation == exact[r.vec_id] for r in rows)
    v = np.array((n * (x.T @ x) - np.outer(s, s)) / n**2, float)
    values, vectors = np.linalg.eigh(v)
    got = _whitened(rows)
    w = np.array([got[i] for i, _ in table])
    for c in range(32):
        want = np.array((x - s / n).astype(float)) @ vectors[:, -1 - c] / np.sqrt(values[-1 - c])
        assert min(np.abs(w[:, c] - want).max(), np.abs(w[:, c] + want).max()) < 1e-6
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9 and all(r.identity_error < 1e-9 for r in rows)
    assert all(r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9) for r in rows)


def test_whitening_edge(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 2.0]), (1, [0.1, 2.0]), (None, [5.0, -1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-30000.0, 3.0]), (7, [1.0])]
    got = Q.op11_embedding_whitening(spark, _table(spark, tmp_path, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 1, 6, 7) for c in (1, 2)) and all(r.n == 5 for r in got)
    x = np.array([[int(np.floor(64 * np.float32(c).astype(float))) + 1_000_000 for c in v] for v in ([0.1, 2], [0.1, 2], [5, -1], [-30000, 3], [1, 0])], object)
    d = ((5 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert {(r.vec_id or 0, r.deviation) for r in got} == set(zip((1, 1, 0, 6, 7), d, strict=True)) and all(r.identity_error < 1e-4 for r in got)
    same = Q.op11_embedding_whitening(spark, _table(spark, tmp_path / "same", [(1, [0.5, 1.5]), (2, [0.5, 1.5])]))
    assert same.count() == 0  # no variance, no component
    assert Q.op11_embedding_whitening(spark, _table(spark, tmp_path / "none", [(2, None)])).collect() == []


def test_large_deviations_stay_exact(spark):
    big = 1 << 40
    df = spark.createDataFrame([(i, [i * big, -i]) for i in range(5)], "vec_id long, vector array<long>")
    got = {r.vec_id: int(r.deviation) for r in W.whiten(df).collect()}
    assert got == {i: (5 * i * big - 10 * big) ** 2 + (5 * -i + 10) ** 2 for i in range(5)}


# ---- clustering


@pytest.mark.parametrize("number", [np.float64, np.int64, object])
def test_scan_equals_all_distances(number):
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, c = rng.integers(-3, 4, (300, 2)), rng.integers(-3, 4, (6, 2))  # many ties, equal centroids
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        got = C.assign(x.astype(number), c.astype(number), rng.integers(0, 6, 300))
        assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()


def test_scan_leaves_distances_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-9000, 9000, (16, 8))
    own = rng.integers(0, 16, 4000)
    x = centres[own] + rng.integers(-50, 51, (4000, 8))
    cluster, _, looked = C.assign(x.astype(float), centres.astype(float), own)
    assert (cluster == own).all() and looked < 2 * len(x)


def test_exact_types():
    assert C.exact_type(1000, 64) is np.float64 and C.exact_type(10**7, 64) is np.int64 and C.exact_type(10**12, 64) is object


def _lloyd(rows, k=8, rounds=10, dim=64):
    kept = [(i, tuple(int(np.floor(1024 * float(np.float32(c)))) for c in v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cent = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cent = [tuple(sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)) if groups[n] else c for n, c in enumerate(cent)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    own = defaultdict(int)
    for _, n, d in got:
        own[n] += d
    return sorted(map(str, [(i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, cent[n])).encode()).hexdigest()) for i, n, d in got]))


def test_means_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i // 2 if i % 9 else None, [float(x) for x in rng.integers(-2, 3, 64) / 8.0]) for i in range(120)]
    rows += [(3, rows[7][1]), (3, rows[7][1]), (900, None), (901, [1.0]), (902, [float("nan")] * 64), (903, [None] * 64), (904, [1.0] * 65)]
    got = Q.op13_sort_means(spark, _table(spark, tmp_path, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == _lloyd(rows)


def test_means_of_few_rows(spark, tmp_path):
    rows = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-1.0] * 64)]
    got = Q.op13_sort_means(spark, _table(spark, tmp_path, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == _lloyd(rows)
    assert Q.op13_sort_means(spark, _table(spark, tmp_path / "none", [(2, None)])).collect() == []


def test_means_equal_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{data}/sf0.001/embeddings.parquet')")
    want = con.execute(Q.ORACLES["op13_sort_means"])
    names = [c[0] for c in want.description]
    rows = Q.op13_sort_means(spark, f"{data}/sf0.001").select(*names).withColumn("vec_id", F.col("vec_id")).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
