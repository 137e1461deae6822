"""Golden values and identities of single operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import scalars as S
from strandloom.functions import strings as T
from strandloom.operators import aggregates as A
from strandloom.operators import batch as B
from strandloom.operators import baselines as BL
from strandloom.operators import graph as G
from strandloom.operators import joins as J
from strandloom.operators import ordered as O
from strandloom.operators import priors as P
from strandloom.operators import select as L
from strandloom.operators import splits as D
from strandloom.operators.optimise import AdaGrad, bisect_monotone, ista_nonnegative, lbfgs, masked_least_squares, with_halving
from strandloom.sources import files as I


def _value(spark, col):
    return spark.range(1).select(col).first()[0]


def test_contiguity_and_ranges(spark):
    for ids, want in (([2, 2, 2, 1, 1, 4, 4, 4], True), ([1, 1, 5, 5, 1, 3, 3, 3], False)):
        df = spark.createDataFrame(list(enumerate(ids)), "pos int, id int")
        assert O.is_contiguous(df, "id", "pos").first()[0] is want
    df = spark.createDataFrame(list(enumerate([2, 2, 2, 1, 1, 4, 4, 4], 1)), "pos int, id int")
    assert {(r.id, r.start, r.stop) for r in O.ranges(df, "id", "pos").collect()} == {(2, 1, 3), (1, 4, 5), (4, 6, 8)}


def test_clip_ranges(spark):
    def clip(rng, low, high):
        return [tuple(r) for r in O.clip_ranges(spark.createDataFrame([(i, *r) for i, r in enumerate(rng, 1)], "idx int, start int, stop int"), low, high).orderBy("idx").collect()]

    assert clip([(1, 2), (3, 4), (5, 5)], 2, 5) == [(1, 2, 2), (2, 3, 4), (3, 5, 5)]
    assert clip([(1, 2), (5, 6), (8, 10)], 5, 8) == [(2, 5, 6), (3, 8, 8)]


def test_keymatch(spark):
    left = spark.createDataFrame(list(zip(range(1, 5), ["cat", "dog", "fish", "bird"], strict=True)), "pos int, key string")
    right = spark.createDataFrame(list(zip(range(1, 4), ["dog", "bird", "cat"], strict=True)), "pos int, key string")
    assert [tuple(r) for r in J.keymatch(left, right).orderBy("left_pos").collect()] == [(1, 3), (2, 1), (4, 2)]


def test_missing_value_statistics(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, float("nan"), 2.0, float("nan"), 3.0)], "g int, x double")
    s = A.column_stats(df.select("g", S.finite(F.col("x")).alias("value")), "g").first()
    assert (s.total, s["mean"], s.var_samp) == (6, 2, 1)


def test_signed_laplacian(spark):
    e = spark.createDataFrame([(0, "a", "b", 1.0), (1, "b", "c", 1.0), (2, "c", "d", -1.0), (3, "d", "a", -1.0)], "pos int, src string, dst string, weight double")
    got = {(r.i, r.j): r.v for r in G.laplacian(e, 0.1).collect()}
    assert all(got[v, v] == pytest.approx(2.1) for v in "abcd")
    assert got["a", "b"] == got["b", "c"] == -1 and got["c", "d"] == got["d", "a"] == 1 and len(got) == 12


def test_leaf_pruning(spark):
    square = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    e = spark.createDataFrame([(1, *p, 1.0) for p in [*square, ("d", "e"), ("e", "g"), ("c", "f"), ("f", "h")]], "pathway_id int, src string, dst string, weight double")
    assert {(r.src, r.dst) for r in G.prune_leaves(e, ["f"]).collect()} == {*square, ("c", "f")}


def test_average_precision_with_ties(spark):
    for score, truth in (([0, 0, 0.5, 0.5, 1], [0, 0, 0, 1, 1]), ([0, 0.5, 0, 1, 0.5], [0, 0, 0, 1, 1])):
        df = spark.createDataFrame([(float(s), bool(t)) for s, t in zip(score, truth, strict=True)], "s double, t boolean")
        assert O.average_precision(df, "s", "t").first()[0] == pytest.approx(5 / 6)


def test_sif_decoding(spark, tmp_path):
    rows = ["MOL:GTP\ta>\tX/Y", "METAPHASE\ta>\tPLK1", "PP2A-ALPHA B56\ta|\tSGOL1", "P\tt|\tQ"]
    (tmp_path / "set_7.sif").write_text("\n".join(rows))
    df = I.read_sif(spark, str(tmp_path / "set_7.sif"))
    got = [tuple(r) for r in df.select(T.edge_source(F.col("src")), T.edge_target(F.col("dst"), F.col("itype")), T.edge_weight(F.col("itype"))).collect()]
    assert ("MOL:GTP_activation", "X/Y_activation", 1.0) in got and ("PP2A-ALPHA B56_activation", "SGOL1_activation", -1.0) in got and ("P_activation", "Q_mrna", -1.0) in got
    names = spark.createDataFrame([(7, "seven")], "id int, name string")
    assert {r.name for r in I.name_sif(df, names).collect()} == {"seven"}


def test_pathway_features(spark):
    """The nine features of the pathway fixture: sets per view, chain and data edges."""
    feats = [("PLK1", "cna", "dna", 1.0), ("PLK1", "mutation", "dna", -1.0), ("PLK1", "mrnaseq", "mrna", 1.0), ("PAK1", "rppa", "protein", 1.0), ("PAK1", "methylation", "mrna", -1.0), ("PAK1", "mutation", "dna", -1.0), ("SGOL1", "mrnaseq", "mrna", 1.0), ("BRCA", "mrnaseq", "mrna", 1.0), ("BRCA", "methylation", "mrna", -1.0)]
    f = spark.createDataFrame([(i, g, v, d, w) for i, (g, v, d, w) in enumerate(feats, 1)], "pos int, gene string, view string, dogma string, weight double")
    names = G.membership_ids(f).withColumnRenamed("name", "feature_id")
    members = spark.createDataFrame([(1, g) for g in ("PLK1", "PAK1", "SGOL1", "RAB1A")], "set_id int, gene string")
    sets = J.feature_sets_by_view(members, names.select("feature_id", "view", "gene"))
    got = {}
    for r in sets.collect():
        got.setdefault(r.view, set()).add(r.feature_id)
    assert got == {"cna": {"PLK1_1"}, "mutation": {"PLK1_2", "PAK1_6"}, "mrnaseq": {"PLK1_3", "SGOL1_7"}, "rppa": {"PAK1_4"}, "methylation": {"PAK1_5"}}
    assert G.dogma_edges(members.where("gene in ('PLK1', 'PAK1', 'SGOL1')")).count() == 9
    data = G.data_edges(names.select(T.compound(F.col("gene"), F.col("dogma"), F.col("pos").cast("string")).alias("feature"), "gene", "weight"))
    assert {(r.src, r.dst, r.weight) for r in data.collect()} >= {("PLK1_dna_1", "PLK1_dna", 1.0), ("BRCA_mrna_9", "BRCA_mrna", -1.0)}


def test_batch_array(spark):
    views = ["cat", "cat", "cat", "bird", "dog", "dog", "fish"]
    batches = {"cat": [1, 1, 1, 2, 2], "dog": [1, 1, 2, 2, 2], "fish": [1, 1, 1, 1, 2]}
    values = {"cat": {1: 3.14, 2: 2.7}, "dog": {1: 0.0, 2: 0.5}, "fish": {1: -1.0, 2: 1.0}}
    obs = spark.createDataFrame([(v, s, str(j), 0.0) for s in range(5) for j, v in enumerate(views)], "view string, sample_id int, feature_id string, value double")
    bmap = spark.createDataFrame([(v, s, b) for v, x in batches.items() for s, b in enumerate(x)], "view string, sample_id int, batch int")
    vals = spark.createDataFrame([(v, b, str(j), x) for v, d in values.items() for b, x in d.items() for j, w in enumerate(views) if w == v], "view string, batch int, feature_id string, batch_value double")

    def matrix(how, value):
        m = np.zeros((5, 7))
        for r in J.batch_apply(obs.withColumn("value", F.lit(value)), bmap, vals, how).collect():
            m[r.sample_id, int(r.feature_id)] = r.result
        return m

    want = np.array([[3.14] * 3 + [0, 0, 0, -1]] * 2 + [[3.14] * 3 + [0, 0.5, 0.5, -1]] + [[2.7] * 3 + [0, 0.5, 0.5, -1]] + [[2.7] * 3 + [0, 0.5, 0.5, 1]])
    assert np.allclose(matrix("add", 0.0), want)
    want[:, 3] = 1
    assert np.allclose(matrix("multiply", 1.0), want)
    sums = {(r.view, r.batch): r.total for r in A.batch_sums(J.batch_apply(obs, bmap, vals, "add").drop("batch").withColumn("value", F.col("result")), bmap, lambda c: c).collect()}
    assert {k: round(v, 6) for k, v in sums.items()} == {("cat", 1): 9.42, ("cat", 2): 5.4, ("dog", 1): 0, ("dog", 2): 1.5, ("fish", 1): -4, ("fish", 2): 1}
    counts = {(r.view, r.batch): r.total for r in A.batch_sums(obs, bmap, lambda c: c.isNotNull().cast("int")).collect()}
    assert counts == {("cat", 1): 3, ("cat", 2): 2, ("dog", 1): 2, ("dog", 2): 3, ("fish", 1): 4, ("fish", 2): 1}


def test_network_blocks():
    edges = [("1", "2", 1.0), ("2", "3", 1.0), ("3", "4", 1.0)]
    aa, ab, bb, virtual = G.laplacian_blocks(edges, ["1", "2", "3"], 0.1)
    assert np.allclose(aa, [[1.1, -1, 0], [-1, 2.1, -1], [0, -1, 2.1]]) and np.allclose(ab, [[0], [0], [-1]]) and np.allclose(bb, [[1.1]]) and virtual == ["4"]
    aa, ab, bb, _ = G.laplacian_blocks([("1", "2", 1.0), ("1", "3", 1.0), ("1", "4", 1.0)], ["2", "3", "4"], 0.1)
    assert np.allclose(aa, 1.1 * np.eye(3)) and np.allclose(ab, -1) and np.allclose(bb, [[3.1]])
    x = np.array([0.3, -1.0, 2.0])
    loss, grad, _ = G.quadratic_with_virtual(aa, ab, bb, x)
    for i in range(3):
        e = np.eye(3)[i] * 1e-6
        assert (G.quadratic_with_virtual(aa, ab, bb, x + e)[0] - loss) / 1e-6 == pytest.approx(grad[i], abs=1e-4)


@pytest.mark.parametrize("kind", S.DISTRIBUTIONS)
def test_losses(spark, kind):
    """Gradients are the derivatives of the losses, in Spark and in the numpy kernels, and both agree."""
    from strandloom.operators.factor import noise_terms

    levels = [1.0, 2.0, 3.0] if kind.startswith("ordinal") else [0.0, 1.0]
    pts = [(z, d) for z in (-2.3, -0.4, 0.7, 1.9) for d in levels]
    z, d = (np.array(c) for c in zip(*pts, strict=True))
    loss, g, _ = noise_terms(kind, z, d)
    assert np.allclose((noise_terms(kind, z + 1e-6, d)[0] - noise_terms(kind, z - 1e-6, d)[0]) / 2e-6, g, atol=1e-5)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "i int, z double, d double").withColumn("k", F.lit(kind))
    args = F.col("k"), F.col("z"), F.col("d")
    rows = df.select("i", S.data_loss(*args).alias("l"), S.data_gradient(*args).alias("g")).orderBy("i").collect()
    assert np.allclose([r.l for r in rows], loss) and np.allclose([r.g for r in rows], g)
    assert np.allclose(noise_terms(kind, z, np.full_like(z, np.nan))[1], 0)


def test_feature_set_ard_scales(spark):
    y = spark.createDataFrame([(k, "v", f"f{j}", 0.1 * j) for k in range(2) for j in range(4)], "k int, view string, feature_id string, v double")
    sets = spark.createDataFrame([("v", "s", f"f{j}", 1 / math.sqrt(2)) for j in (0, 1)], "view string, set_id string, feature_id string, weight double")
    assign = spark.createDataFrame([("v", "s", 0, 2.0), ("v", "s", 1, 0.0)], "view string, set_id string, k int, a double")
    got = {(r.k, r.feature_id): r.beta for r in P.set_scales(assign, sets, y).collect()}
    assert got[0, "f0"] == pytest.approx(0.001 * (0.8 + 2 / math.sqrt(2))) and got[1, "f0"] == got[0, "f3"] == pytest.approx(0.0008)


def test_optimisers():
    a, b = np.diag([1.0, 10.0, 100.0]), np.array([1.0, -2.0, 3.0])
    x, losses = lbfgs(lambda v: (float(0.5 * v @ a @ v - b @ v), a @ v - b), np.zeros(3))
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-4) and all(q <= p + 1e-12 for p, q in zip(losses, losses[1:], strict=False))
    p, opt = {"w": np.array([5.0])}, AdaGrad(1.0)
    for _ in range(400):
        opt.step(p, {"w": 2 * (p["w"] - 1)})
    assert p["w"][0] == pytest.approx(1, abs=1e-2)
    q = ista_nonnegative(np.array([0.2, 0.0]), np.array([1.0, -1.0]), np.full(2, 1e-8), np.full(2, 0.1), 0.1)
    assert q[0] >= 0 and q[1] > 0
    seen = []
    out = with_halving(lambda r, e: seen.append(r) or {"term_code": "loss_increase" if r > 0.3 else "max_epochs", "epochs": e + 1}, 1.0)
    assert seen == [1.0, 0.5, 0.25] and out["rate"] == 0.25
    assert bisect_monotone(lambda v: v**3, 27.0) == pytest.approx(3, abs=1e-6)
    z = np.array([[1.0, np.nan, 3.0], [np.nan] * 3])
    y = np.array([[1.0, 1.0, 0.0], [0.0, 1.0, 1.0]])
    assert np.allclose(masked_least_squares(z, y), [[1, 3], [0, 0]], atol=1e-6)


def test_assignment():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n, m in ((4, 4), (3, 5), (5, 3)):
        s = rng.random((n, m))
        best = max(sum(s[i, j] for i, j in zip(*pairs, strict=True)) for pairs in ([(range(n), p) for p in permutations(range(m), n)] if n <= m else [(p, range(m)) for p in permutations(range(n), m)]))
        assert sum(s[i, j] for i, j in J.assignment(s)) == pytest.approx(best)


def test_scalars(spark):
    assert _value(spark, S.stage_code(F.lit("Stage IIIA"))) == 2 and _value(spark, S.stage_code(F.lit("x"))) is None
    assert _value(spark, S.shrunken_logit(F.lit(0.5))) == pytest.approx(0)
    assert _value(spark, T.barcode_batch(F.lit("TCGA-01-A-22-07"))) == "22-07" and _value(spark, T.barcode_batch(F.lit(""))) == ""
    assert _value(spark, S.three_level(F.lit(None).cast("double"))) is None


def test_sources(spark, tmp_path):
    (tmp_path / "r.txt").write_text("PARTICIPANT_A\tINTERACTION_TYPE\tPARTICIPANT_B\tPATHWAY_NAMES\nA\tcontrols-expression-of\tB\tp1;p2\nA\tx\tC\tp1\nQ\tx\tR\t\n\nPARTICIPANT\tTYPE\nA\tz\n")
    got = {tuple(r) for r in I.read_extended_sif(spark, str(tmp_path / "r.txt")).select("name", "src", "itype", "dst").collect()}
    assert got == {("p1", "A", "t>", "B"), ("p2", "A", "t>", "B"), ("p1", "A", "a>", "C")}
    (tmp_path / "g.json").write_text('{"S1": {"geneSymbols": ["A", "B"], "x": 1}, "S2": {"geneSymbols": ["C"]}}')
    assert {(r.name, r.src, r.dst) for r in I.read_gene_sets(spark, str(tmp_path / "g.json")).collect()} == {("S1", "A", "A"), ("S1", "B", "B"), ("S2", "C", "C")}
    (tmp_path / "c.json").write_text('{"names": ["p", "q"],\n "pathways": [[["a", "a>", "b"]], [["c", "t|", "d"], ["e", "a>", "f"]]]}')
    col = I.read_collection(spark, str(tmp_path / "c.json"))
    assert {(r.name, r.pos, r.src) for r in col.collect()} == {("p", 0, "a"), ("q", 0, "c"), ("q", 1, "e")}
    I.write_collection(col, str(tmp_path / "out"))
    assert {tuple(r) for r in I.read_collection(spark, str(tmp_path / "out"), lines=True).collect()} == {tuple(r) for r in col.collect()}
    (tmp_path / "w.tsv").write_text("id\ts1\ts2\nf1\t1.5\tNaN\nf2\tinf\t2\n")
    assert {tuple(r) for r in I.read_wide_tsv(spark, str(tmp_path / "w.tsv")).collect()} == {("f1", "s1", 1.5), ("f1", "s2", None), ("f2", "s1", None), ("f2", "s2", 2.0)}
    I.write_tsv(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path / "t"))
    assert [tuple(r) for r in I.read_tsv(spark, str(tmp_path / "t")).collect()] == [("1", "a")]


def test_splits(spark):
    s = spark.createDataFrame([(str(i), f"g{i % 23}", "ab"[i % 3 == 0]) for i in range(300)], "sample_id string, g string, label string")
    out = D.stratified_group_split(s, "g", "label", [0.7, 0.3], seed=1).collect()
    place = {}
    for r in out:
        assert place.setdefault(r.g, r.split) == r.split
    assert len(out) == 300 and set(place.values()) == {0, 1}
    folds = D.cv_folds(s, 5, "label", seed=2).groupBy("label", "fold").count().collect()
    assert max(r["count"] for r in folds if r.label == "b") - min(r["count"] for r in folds if r.label == "b") <= 1
    assert D.sample_rows(s, 10, "sample_id", seed=3).collect() == D.sample_rows(s.repartition(7), 10, "sample_id", seed=3).collect()
    feats = spark.createDataFrame([(f"f{i}", f"g{i % 10}") for i in range(40)], "feature_id string, gene string")
    sub = D.feature_subset(feats, spark.createDataFrame([("g1",), ("g2",)], "gene string"), 10).collect()
    assert len(sub) == 10 and sum(r.gene in ("g1", "g2") for r in sub) == 8


def test_graph_corruption(spark):
    rng = np.random.default_rng(0)
    rows = [(p, f"{a}", f"{b}", float(rng.choice([-1, 1]))) for p in ("p", "q") for a, b in rng.integers(0, 25, (60, 2)) if a != b]
    e = spark.createDataFrame(rows, "pathway_id string, src string, dst string, weight double")
    new = G.rewire(e, seed=1).collect()
    assert new == G.rewire(e.repartition(5), seed=1).collect() or sorted(new) == sorted(G.rewire(e.repartition(5), seed=1).collect())
    pairs = [(r.pathway_id, r.weight, *sorted((r.src, r.dst))) for r in new]
    assert len(pairs) == len(set(pairs)) and abs(len(pairs) - G.signed_edges(e, "pathway_id").count()) <= 12
    c = G.corrupt_nodes(e, [f"x{i}" for i in range(50)], 0.2, 0.3, seed=2)
    n = {p: len({v for q, a, b, _ in rows if q == p for v in (a, b)}) for p in ("p", "q")}
    fresh = {p: {r.src for r in c.collect() if r.pathway_id == p and r.src.startswith("x")} for p in n}
    assert all(len(fresh[p]) == math.ceil(0.3 * n[p]) for p in n)
    pool = spark.createDataFrame([(f"z{i}", float(i)) for i in range(20)], "pathway_id string, weight double")
    got = G.corrupt_list(spark.createDataFrame([("p",), ("q",)], "pathway_id string"), pool, 0.5, 1.0).collect()
    assert sum(r.pathway_id.startswith("z") for r in got) == 2 and len(got) == 3


def test_greedy_cover(spark):
    sets = {"a": "1234", "b": "345", "c": "56", "d": "6"}
    df = spark.createDataFrame([(s, m) for s, ms in sets.items() for m in ms], "set_id string, member string")
    assert sorted(map(tuple, G.rank_cover(df).collect())) == [(1, "a", 4), (2, "c", 2), (3, "b", 0), (4, "d", 0)]


def test_batch_effects_converge(spark):
    rng = np.random.default_rng(1)
    shift = {b: rng.normal(b, 0.3, 6) for b in (0, 1, 2)}
    rows = [(f"s{i}", f"f{j}", "v", float(rng.normal() + shift[i % 3][j])) for i in range(90) for j in range(6)]
    obs = spark.createDataFrame(rows, "sample_id string, feature_id string, view string, value double")
    samples = spark.createDataFrame([(f"s{i}", "c") for i in range(90)], "sample_id string, condition string")
    bmap = spark.createDataFrame([("v", f"s{i}", i % 3) for i in range(90)], "view string, sample_id string, batch int")
    fit, rounds = B.fit_batch_effects(obs, bmap, samples, rounds=30)
    got = {(r.batch, r.feature_id): r.theta for r in fit.collect()}
    true = {(b, f"f{j}"): shift[b][j] - np.mean([shift[c][j] for c in shift]) for b in shift for j in range(6)}
    assert np.corrcoef([got[k] for k in sorted(true)], [true[k] for k in sorted(true)])[0, 1] > 0.95 and rounds <= 30
    clean = B.remove_batch(obs, bmap, fit.withColumn("mu", F.lit(0.0)))
    left = B.least_squares_start(B.residual_statistics(clean, bmap, samples)).agg(F.max(F.abs("theta_lsq"))).first()[0]
    assert left < 0.5


def test_selection(spark):
    obs = spark.createDataFrame([(s, f"f{f}", "v", float(s * f)) for s in range(10) for f in range(10)], "sample_id int, feature_id string, view string, value double")
    assert {r.feature_id for r in L.top_variance(obs, 0.25).collect()} == {"f7", "f8", "f9"}
    assert L.count_filter(obs.where("value > 20"), 4).select("feature_id").distinct().count() == 5


def test_top_variance_keeps_the_feature_at_the_cut(spark):
    """Sums added in another order differ in the last digits each time they are computed; the cut follows them.

    Spark may reuse an exchange of two equal branches, but need not; here it does not.
    """
    rows = [(f"v{v:02d}", f"f{v:02d}", float(s)) for v in range(40) for s in range(3)]
    schema = "view string, feature_id string, value double"

    def shaken(batches):
        rng = np.random.default_rng()
        for b in batches:
            yield b.assign(value=b["value"] * (1 + 1e-9 * rng.standard_normal(len(b))))

    obs = spark.createDataFrame(rows, schema).mapInPandas(shaken, schema)
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert L.top_variance(obs, 1.0).count() == 40
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_two_columns_take_rows_with_equal_keys_and_skip_gaps(spark, tmp_path):
    from strandloom.plans.model_queries import pca_two_columns  # noqa: F401  registers the query
    from strandloom.plans.queries import QUERIES

    rng = np.random.default_rng(5)
    q, p = rng.integers(1, 51, 60).astype(float), rng.uniform(1, 1000, 60)
    rows = [(0, i % 7, 0, 0, float(q[i]), float(p[i])) for i in range(60)] + [(1, 0, 0, 0, None, 1e6), (1, 1, 0, 0, 50.0, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    share = QUERIES["pca_two_columns"](spark, str(tmp_path)).first()[0]
    assert share == round((1 + abs(np.corrcoef(q, p)[0, 1])) / 2, 4)


def test_two_columns_take_one_pass_and_shuffle_no_rows(spark, tmp_path):
    from strandloom.plans.queries import QUERIES

    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    tracker = spark.sparkContext.statusTracker()
    for name, rows in (("many", [(i, 1, float(i * 37 % 50), float(i * 91 % 977)) for i in range(3000)]), ("none", []), ("one", [(1, 1, 2.0, 3.0)]), ("constant", [(i, 1, 2.0, float(i)) for i in range(9)])):
        spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        spark.sparkContext.setJobGroup(f"pca-{name}", name)
        try:
            share = QUERIES["pca_two_columns"](spark, f"{tmp_path}/{name}").first()[0]
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if name == "many":
            q, p = np.array(rows)[:, 2:].T
            assert share == round((1 + abs(np.corrcoef(q, p)[0, 1])) / 2, 4)
            assert len(tracker.getJobIdsForGroup("pca-many")) <= 5  # listing, one pass, the answer; rounds over long rows take dozens
        else:  # as corr() in SQL: null without rows, NaN without variance
            assert share is None if name == "none" else np.isnan(share)
    _, shares = BL.pca_columns(spark.read.parquet(f"{tmp_path}/many/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_orderkey"], 3)
    want = np.linalg.eigvalsh(np.corrcoef(np.array([(r[2], r[3], r[0]) for r in [(i, 1, float(i * 37 % 50), float(i * 91 % 977)) for i in range(3000)]]).T))[::-1] / 3
    assert np.allclose(shares, want)


def test_no_task_makes_most_pairs_of_a_product(spark):
    x, y = np.arange(1200).reshape(400, 3) % 17 / 4, np.arange(90).reshape(3, 30) % 13 / 8
    a = spark.createDataFrame([(i, k, float(x[i, k])) for i in range(400) for k in range(3)], "i int, k int, v double")
    b = spark.createDataFrame([(k, j, float(y[k, j])) for k in range(3) for j in range(30)], "k int, j int, v double")
    got = {(r.i, r.j): r.v for r in J.matrix_product(a, b).collect()}
    want = x @ y
    assert got == {(i, j): want[i, j] for i in range(400) for j in range(30)}
    made = [r["count"] for r in J.product_pairs(a, b.coalesce(1)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 36000 and max(made) < 3600


def test_average_ranks_of_values_and_gaps(spark):
    rows = [("a", 2.0), ("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, t double")
    got = sorted((str(r.g), str(r.t), r.r) for r in A.with_average_rank(df, "t", "r", "g").collect())
    assert got == [("None", "5.0", 1.5), ("None", "5.0", 1.5), ("a", "1.0", 1.0), ("a", "2.0", 2.5), ("a", "2.0", 2.5), ("a", "None", 4.0)]
    both = spark.range(5000).select(F.lit(1).alias("one"), (F.col("id") * 37 % 501).cast("double").alias("t"), (F.col("id") * 11 % 97).cast("double").alias("f"))
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", A.recovery(both, "one")._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("__bucket" in w for w in windows)  # over counts of values in a bucket, never over a group's rows
    t, f = (np.array([(i * a % m) for i in range(5000)], float) for a, m in ((37, 501), (11, 97)))
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    want = np.corrcoef(mean_rank(t), mean_rank(f))[0, 1]
    assert A.recovery(both, "one").first().spearman == pytest.approx(want, abs=1e-9)
