"""Queries of sources, the factor model, its priors and optimisers, simulation, baselines and scores.

Fits, draws and matchings have no SQL form of their own; their queries give what
has to hold of the result, and the SQL says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.functions import scalars as S
from strandloom.functions import strings as T
from strandloom.operators import baselines as BL
from strandloom.operators import batch as B
from strandloom.operators import descent as DE
from strandloom.operators import evaluate as E
from strandloom.operators import graph as G
from strandloom.operators import joins as J
from strandloom.operators import optimise as O
from strandloom.operators import ordered as W
from strandloom.operators import regularise as P
from strandloom.operators import reshape as R
from strandloom.operators import select as L
from strandloom.operators import simulate as SM
from strandloom.operators import splits as D
from strandloom.operators import sums as U
from strandloom.operators import survival as SV
from strandloom.operators.factor import BatchLayers, FactorModel, packed_rows
from strandloom.plans.matrix import BATCHES, CELLS, EDGES, FEATURES, MEMBERS, OBS, SAMPLES, SMALL_EDGES, X, Y, ctes, dense
from strandloom.plans.queries import _DISC, _EM, _LAP, _Z, _typed, query, r
from strandloom.sources import files as I
from strandloom.sources.scratch import new_path
from strandloom.streaming.transform import latest_factors, transform_split_stream

# ---------------------------------------------------------------- sources


@query("SELECT coalesce(n_name, CAST(p_size AS VARCHAR)) AS name, p_brand AS src, 'a>' AS itype, p_type AS dst FROM part LEFT JOIN nation ON n_nationkey = p_size")
def collection_names(t):
    e = t.part.select(F.format_string("x/pathways_%d.sif", "p_size").alias("file"), F.col("p_brand").alias("src"), F.lit("a>").alias("itype"), F.col("p_type").alias("dst"))
    return I.name_sif(e, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("SELECT p_type AS name, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_brand AS src, 't>' AS itype, p_name AS dst FROM part")
def collection_round_trip(t):
    path = new_path(t.spark, "collection")
    I.write_collection(t.part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("src"), F.lit("t>").alias("itype"), F.col("p_name").alias("dst")), path)
    return I.read_collection(t.spark, path, lines=True)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def tsv_round_trip(t):
    path = new_path(t.spark, "tsv")
    I.write_tsv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return I.read_tsv(t.spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("SELECT c_custkey, c_acctbal, CAST(c_custkey % 5 AS INTEGER) AS fold FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 = 2")
def split_sink(t):
    path = new_path(t.spark, "splits")
    split = F.when(F.col("c_custkey") % 3 == 0, "test").otherwise("train")
    I.write_splits(t.customer.select("c_custkey", "c_acctbal", split.alias("split"), (F.col("c_custkey") % 5).cast("int").alias("fold")), path, "split", "fold")
    return t.spark.read.parquet(path).where("split = 'test' AND fold = 2").select("c_custkey", "c_acctbal", "fold")


@query(ctes(OBS) + "SELECT sample_id, feature_id, view, round(value, 4) AS value, CASE WHEN sample_id % 2 = 0 THEN sample_id / 2.0 END::DOUBLE AS target FROM obs")
def labelled_matrix(t):
    path = new_path(t.spark, "matrix")
    t.obs.select("sample_id", "feature_id", "view", "value").write.parquet(f"{path}/obs")
    t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_suppkey") / 2).alias("target")).write.parquet(f"{path}/stage")
    assert I.read_matrix(t.spark, path).where("target <> 1").limit(1).count() == 0
    return I.read_matrix(t.spark, path, "stage").withColumn("value", r("value", 4))


_PARAMS = """, pars AS (SELECT feature_id, view, distribution, j, (j % 7 - 3) / 10.0::DOUBLE AS mu, (j % 5 - 2) / 10.0::DOUBLE AS logsigma FROM features)"""


def _model(t, k: int = 3, plain: bool = False) -> FactorModel:
    """A model of given parameters; ``plain``: normal noise, no shift, unit scale."""
    f = t.features.toPandas()
    f["mu"], f["logsigma"] = (f["j"] % 7 - 3) / 10, (f["j"] % 5 - 2) / 10
    if plain:
        f["distribution"], f["mu"], f["logsigma"] = "normal", 0.0, 0.0
    f["weight"], f["cut1"], f["cut2"] = 1.0, -1.0, 1.0
    f = f.sort_values(["distribution", "view", "feature_id"]).reset_index(drop=True)[["feature_id", "view", "distribution", "mu", "logsigma", "weight", "cut1", "cut2"]]
    ids = sorted(f["feature_id"])
    place = {v: i for i, v in enumerate(ids)}
    y = E.long_to_array(t.y(k), "feature_id", k)[:, [place[v] for v in f["feature_id"]]]
    x = t.x(k).groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("x"))
    return FactorModel(k, features=f, y=y, factors=x.select(F.col("sample_id").cast("string").alias("sample_id"), "x"))


def _saved(t) -> FactorModel:
    path = new_path(t.spark, "model")
    _model(t).save(t.spark, path)
    return FactorModel.load(t.spark, path)


@query(ctes(CELLS, FEATURES, Y) + "SELECT feature_id, CAST(k AS INTEGER) AS k, v FROM y")
def model_round_trip(t):
    m = _saved(t)
    rows = [(f, k, float(m.y[k, i])) for i, f in enumerate(m.features["feature_id"]) for k in range(m.k)]
    return t.spark.createDataFrame(rows, "feature_id string, k int, v double")


@query(ctes(CELLS, FEATURES) + _PARAMS + "SELECT feature_id, view, distribution, round(mu, 6) AS mu, round(logsigma, 6) AS logsigma FROM pars")
def exported_features(t):
    return _saved(t).tables(t.spark)["features"].select("feature_id", "view", "distribution", r("mu").alias("mu"), r("logsigma").alias("logsigma"))


@query(ctes(SAMPLES, X) + "SELECT sample_id, CAST(k AS INTEGER) AS k, v FROM x")
def exported_factors(t):
    return _saved(t).factors.select(F.col("sample_id").cast("long").alias("sample_id"), F.posexplode("x").alias("k", "v"))


@query(ctes(CELLS, FEATURES, BATCHES) + "SELECT view, batch, min(batch * 10000 + j) AS first, count(*) AS features FROM batch_values JOIN features USING (view, feature_id) GROUP BY ALL")
def exported_batches(t):
    b = t.batch_values.join(t.features.select("view", "feature_id", "j"), ["view", "feature_id"])
    return I.batch_ids(b.withColumn("pos", (F.col("batch") * 10000 + F.col("j")).cast("long")))


# ---------------------------------------------------------------- small operators


@query("SELECT s_suppkey, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, '7,7,7' AS set FROM supplier")
def filled_columns(t):
    return t.supplier.select("s_suppkey", F.lit(0.0).alias("zero"), F.lit(1.0).alias("one"), F.array_join(F.array_repeat(F.lit("7"), 3), ",").alias("set"))


@query("""WITH n AS (SELECT p_type, round_even(40 * (count(*) / sum(count(*)) OVER ()), 0) AS want FROM part GROUP BY 1)
    SELECT p_type, CAST(greatest(least(want, 40 - coalesce(sum(want) OVER (ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS BIGINT) AS n FROM n""")
def proportional_shares(t):
    rows = t.part.groupBy("p_type").count().orderBy("p_type").collect()
    total = sum(x["count"] for x in rows)
    return t.spark.createDataFrame(list(zip([x["p_type"] for x in rows], W.proportional_allocation([x["count"] / total for x in rows], 40), strict=True)), "p_type string, n long")


@query("SELECT c_custkey AS sample_id, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS sample_idx FROM customer")
def samples_by_condition(t):
    s = t.customer.select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("condition"), F.col("c_custkey").alias("raw_idx"))
    return L.by_condition(s).select("sample_id", F.col("sample_idx").cast("long").alias("sample_idx"))


@query(ctes(CELLS, FEATURES, BATCHES) + "SELECT view, batch, feature_id, round(exp(batch_value), 6) AS e, round(ln(batch_value), 6) AS l, 0.0::DOUBLE AS z FROM batch_values")
def batch_exp_log(t):
    v = F.col("batch_value")
    return t.batch_values.select("view", "batch", "feature_id", r(F.exp(v)).alias("e"), r(F.ln(v)).alias("l"), F.lit(0.0).alias("z"))


@query("SELECT p_partkey, [0, 1, 2, 3, 0, 2][CAST(p_partkey % 6 AS INTEGER) + 1] AS stage, p_brand AS other FROM part")
def stratification(t):
    names = F.array(*map(F.lit, ("Stage I", "stage ii", "Stage IIIB", "stage iv", "stage ia", "Stage IIIc")))
    return t.part.select("p_partkey", S.stratum("stage", names[(F.col("p_partkey") % 6).cast("int")]).alias("stage"), S.stratum("other", F.col("p_brand")).alias("other"))


@query("SELECT n_nationkey, round(sqrt(n_nationkey + 1), 5) AS root FROM nation")
def bisect_roots(t):
    keys = [x[0] for x in t.nation.select("n_nationkey").collect()]
    return t.spark.createDataFrame([(k, round(O.bisect_monotone(lambda x: x * x, k + 1), 5)) for k in keys], "n_nationkey int, root double")


@query("SELECT * FROM (VALUES ('k', '7'), ('rate', '0.5'), ('joint', 'True'), ('name', 'abc'), ('sizes', '[1, 2, 3]'), ('limit', 'None'), ('seed', '0')) v(name, value)")
def parsed_options(t):
    known = {"k": 3, "rate": 1.0, "joint": False, "name": "", "sizes": None, "limit": 5, "seed": 0}
    got = T.options(known, ["k=7", "--rate=0.5", "joint=true", "name=abc", "sizes=1:2:3", "limit=nothing"])
    return t.spark.createDataFrame([(k, str(v)) for k, v in got.items()], "name string, value string")


@query("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Small parts' WHEN 'PROMO' THEN 'Promotion' ELSE p_type END AS name FROM part")
def display_names(t):
    return t.part.select("p_partkey", T.display_name(F.col("p_type"), {"SMALL": "Small parts", "PROMO": "Promotion"}).alias("name"))


@query("SELECT n_regionkey, n_name AS names, n_nationkey AS keys FROM nation")
def zipped_lists(t):
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    lists = t.nation.groupBy("n_regionkey").agg(F.transform(rows, lambda s: s["n_name"]).alias("names"), F.transform(rows, lambda s: s["n_nationkey"]).alias("keys"))
    return lists.select("n_regionkey", F.inline(F.arrays_zip("names", "keys")))


@query("SELECT l_linenumber AS i, l_orderkey AS j, l_quantity AS v FROM lineitem")
def transposed_matrix(t):
    return R.transpose(t.lineitem.select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("v")))


@query("SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) USING (c_custkey)")
def restored_rows(t):
    part = t.orders.where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return R.restore_order(t.customer.select("c_custkey"), part, "c_custkey")


# ---------------------------------------------------------------- graphs


_U = ", u AS (SELECT pathway_id, least(src, dst) AS lo, greatest(src, dst) AS hi, arg_max(weight, pos) AS weight FROM edges GROUP BY ALL) "


@query(ctes(EDGES) + _U + "SELECT pathway_id, lo AS src, hi AS dst, weight FROM u UNION ALL SELECT pathway_id, hi, lo, weight FROM u WHERE lo <> hi")
def adjacency_list(t):
    return G.adjacency(t.edges, "pathway_id")


@query(ctes(SMALL_EDGES).replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT pathway_id, list({'src': src, 'dst': dst, 'pos': pos}) AS e, -1 AS n FROM small_edges GROUP BY 1
    UNION ALL SELECT pathway_id, list_filter(e, lambda x: list_bool_and([v = 'Brand#1' OR len(list_distinct(list_concat(list_transform(list_filter(e, lambda y: y.src = v), lambda y: y.dst), list_transform(list_filter(e, lambda y: y.dst = v), lambda y: y.src)))) > 1 FOR v IN [x.src, x.dst]])) AS e, len(e) AS n FROM p WHERE len(e) <> n),
    kept AS (SELECT pathway_id, unnest(e).pos AS pos FROM p WHERE len(e) = n) SELECT s.* FROM small_edges s JOIN kept USING (pathway_id, pos)""")
def prune_leaves(t):
    return G.prune_leaves(t.small_edges, ["Brand#1"])


@query(ctes(MEMBERS) + """, s AS (SELECT set_id, count(*) AS n FROM members GROUP BY 1), b AS (SELECT l.set_id AS a, m.set_id AS b, count(*) AS k FROM members l JOIN members m ON l.gene = m.gene AND l.set_id < m.set_id GROUP BY ALL)
    SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM b JOIN s x ON x.set_id = a JOIN s y ON y.set_id = b WHERE k / (x.n + y.n - k) >= 0.4""")
def redundant_sets(t):
    return G.jaccard(t.members.select("set_id", F.col("gene").alias("member")), 0.4).withColumn("jaccard", r("jaccard"))


@query(ctes(MEMBERS).replace("WITH", "WITH RECURSIVE", 1) + """, s AS (SELECT set_id, list(DISTINCT gene) AS m, count(DISTINCT gene) AS size FROM members GROUP BY 1),
    g AS (SELECT 0::BIGINT AS rank, NULL::VARCHAR AS set_id, 1::BIGINT AS new, []::VARCHAR[] AS covered UNION ALL SELECT rank, set_id, new, covered FROM (
        SELECT *, row_number() OVER (ORDER BY new DESC, size DESC, set_id) AS rn FROM (
            SELECT g.rank + 1 AS rank, s.set_id, len(list_filter(s.m, lambda x: NOT list_contains(g.covered, x)))::BIGINT AS new, list_distinct(list_concat(g.covered, s.m)) AS covered, s.size FROM g JOIN s ON g.new > 0)) WHERE rn = 1),
    head AS (SELECT rank, set_id, new FROM g WHERE rank > 0 AND new > 0)
    SELECT * FROM head UNION ALL SELECT (SELECT count(*) FROM head) + row_number() OVER (ORDER BY size DESC, set_id), set_id, 0 FROM s WHERE set_id NOT IN (SELECT set_id FROM head)""")
def rank_cover(t):
    return G.rank_cover(t.members.select("set_id", F.col("gene").alias("member")))


@query(_LAP + """, x AS (SELECT p_brand AS i, CAST(count(*) AS DOUBLE) / 50 AS x FROM part GROUP BY 1),
    q AS (SELECT l.pathway_id, sum(CASE WHEN l.i <> 'Brand#3' AND l.j <> 'Brand#3' THEN l.v * a.x * b.x ELSE 0 END) AS q, sum(CASE WHEN l.i = 'Brand#3' AND l.j <> 'Brand#3' THEN l.v * b.x END) AS ab, max(CASE WHEN l.i = 'Brand#3' AND l.j = 'Brand#3' THEN l.v END) AS bb
        FROM l JOIN x a ON a.i = l.i JOIN x b ON b.i = l.j GROUP BY 1)
    SELECT pathway_id, round(0.5 * (q - coalesce(ab * ab / bb, 0)), 5) AS loss FROM q""")
def network_penalty(t):
    """Brand#3 is not observed: its value is the best one."""
    x = t.part.groupBy(F.col("p_brand").alias("node")).agg((F.count(F.lit(1)) / 50).alias("x"))
    return G.network_penalty(t.edges, x.where("node <> 'Brand#3'"), 0.1).withColumn("loss", r("loss", 5))


@query(ctes(EDGES) + "SELECT DISTINCT pathway_id, true AS simple, true AS known FROM edges")
def rewired_graph(t):
    """No edge twice or from a node to itself, no node that the pathway didn't have."""
    new = G.rewire(t.edges, seed=1)
    own = G.nodes(t.edges, "pathway_id").groupBy("pathway_id").agg(F.collect_set("node").alias("nodes"))
    j = new.join(own, "pathway_id").groupBy("pathway_id").agg(((F.count(F.lit(1)) == F.countDistinct("src", "dst", "weight")) & F.every(F.col("src") != F.col("dst"))).alias("simple"), F.every(F.array_contains("nodes", F.col("src")) & F.array_contains("nodes", F.col("dst"))).alias("known"))
    return t.edges.select("pathway_id").distinct().join(j, "pathway_id", "left")


@query(ctes(EDGES) + """SELECT pathway_id, CAST(least(40, ceil(0.2::DOUBLE * count(DISTINCT n))) AS BIGINT) AS added FROM (SELECT pathway_id, src AS n FROM edges UNION SELECT pathway_id, dst FROM edges) GROUP BY 1""")
def corrupted_graph(t):
    new = G.corrupt_nodes(t.edges, [f"Extra#{i:02d}" for i in range(40)], 0.2, 0.2, seed=1)
    return new.where("src LIKE 'Extra#%'").groupBy("pathway_id").agg(F.count(F.lit(1)).alias("added"))


# ---------------------------------------------------------------- layers, priors


@query(ctes(CELLS, FEATURES, SAMPLES, X, Y) + _Z + _PARAMS + "SELECT sample_id, feature_id, round(z * exp(logsigma) + mu, 5) AS z FROM z JOIN pars USING (feature_id)")
def rotated_latent(t):
    """Layers without batches; turning Y to its singular vectors changes no value."""
    m = _model(t)
    m.rotate()
    return m.latent().select(F.col("sample_id").cast("long").alias("sample_id"), "feature_id", r("z", 5).alias("z"))


@query(ctes(CELLS, FEATURES, SAMPLES, X, Y) + _Z + _PARAMS + """, l AS (SELECT sample_id, feature_id, distribution, z * exp(logsigma) + mu AS z FROM z JOIN pars USING (feature_id))
    SELECT sample_id, feature_id, round(CASE distribution WHEN 'bernoulli' THEN 1 / (1 + exp(-z)) WHEN 'poisson' THEN exp(z) ELSE z END, 4) AS value FROM l""")
def imputed_model(t):
    return _model(t).impute().select(F.col("sample_id").cast("long").alias("sample_id"), "feature_id", r("value", 4).alias("value"))


@query(ctes(CELLS, FEATURES) + """, p AS (SELECT view, (j % 7 - 3)::DOUBLE AS mu, (j % 5 - 2) / 10.0::DOUBLE AS ls FROM features), s AS (SELECT sum(mu * mu) AS m2, sum(ls * ls) AS l2 FROM p),
    e AS (SELECT view, avg(mu) AS c, 0.6 / (0.1 + 0.5 * var_samp(mu)) AS w FROM p GROUP BY 1), b AS (SELECT sum(0.5 * w * pow(mu - c, 2)) AS v FROM p JOIN e USING (view))
    SELECT 'given' AS stage, round(m2 + l2, 5) AS value FROM s UNION ALL SELECT 'frozen', round(m2, 5) FROM s UNION ALL SELECT 'reweighted', round(v + l2, 5) FROM b, s""")
def layer_priors(t):
    f = t.features.orderBy("j").toPandas()
    params = {"mu": (f["j"] % 7 - 3).to_numpy(float), "logsigma": (f["j"] % 5 - 2).to_numpy(float) / 10}
    prior = P.LayerPriors.of(f["view"].to_numpy(), weight=2.0)
    rows = [("given", prior.value(params))]
    prior.freeze("logsigma")
    rows.append(("frozen", prior.value(params)))
    prior.reweight(params)
    prior.unfreeze("logsigma")
    rows.append(("reweighted", prior.value(params)))
    return t.spark.createDataFrame([(s, round(v, 5)) for s, v in rows], "stage string, value double")


@query(ctes(CELLS, FEATURES, Y) + "SELECT round(0.25 * 0.5 * sum(v * v / pow(2, k)) + 0.75 * 1.501 * sum(ln(1 + v * v / 0.002)), 3) AS value FROM y")
def mixture_prior(t):
    y = E.long_to_array(t.y(), "feature_id", 3)
    prior = P.Mixture([P.Ridge(np.array([1.0, 0.5, 0.25])), P.Relevance()], [1, 3])
    return t.spark.createDataFrame([(round(prior.value(y), 3),)], "value double")


@query(ctes(SAMPLES, X) + "SELECT CAST(condition AS VARCHAR) AS condition, round(0.25 / max(total) + 0.25 / sum(v * v), 6) AS w FROM (SELECT *, sum(v * v) OVER () AS total FROM x WHERE k = 0) GROUP BY 1")
def sample_prior(t):
    x = t.x(1).groupBy(F.col("condition").cast("string").alias("condition")).agg(F.sum(F.col("v") ** 2).alias("s")).collect()
    prior = P.SamplePrior.of(1, 1.0, [c["condition"] for c in x])
    prior.reweight({c["condition"]: np.array([[c["s"]]]) for c in x})
    w = prior.weights([c["condition"] for c in x], 1)[:, 0]
    return t.spark.createDataFrame([(c["condition"], round(float(v), 6)) for c, v in zip(x, w, strict=True)], "condition string, w double")


@query(ctes(CELLS, FEATURES, Y) + "SELECT round(0.5 * 0.5 * sum(v * v) + 0.5 * 0.5 * sum(CASE WHEN j % 3 <> k THEN abs(v) ELSE 0 END), 5) AS value FROM y")
def feature_prior(t):
    """Ridge by view and selective L1; the graph of factor k joins the features of places j = k mod 3."""
    f = t.features.orderBy("feature_id").toPandas()
    graphs = [[(a, b, 1.0) for a, b in zip(own, own[1:], strict=False)] for own in (f.loc[f["j"] % 3 == k, "feature_id"].tolist() for k in range(3))]
    prior = P.feature_prior(3, f["view"].to_numpy(), f["feature_id"].tolist(), l2=1.0, selective_l1=0.5, graphs=graphs)
    return t.spark.createDataFrame([(round(prior.value(E.long_to_array(t.y(), "feature_id", 3)), 5),)], "value double")


@query(ctes(OBS, FEATURES) + _DISC + """, m AS (SELECT count(DISTINCT sample_id) AS m FROM obs), s AS (SELECT feature_id, o.distribution, greatest(coalesce(var_samp(d), 0), 1.0 / max(m)) * count(d) AS v FROM o, m GROUP BY ALL)
    SELECT s.distribution, round(3 * avg(exp((j % 5 - 2) / 5.0::DOUBLE)) / (sum(v) / max(m)), 5) AS w FROM s JOIN features USING (feature_id), m GROUP BY 1""")
def minimal_prior(t):
    o = _typed(t).groupBy("feature_id", "distribution").agg(F.var_samp("d").alias("v"), F.count("d").alias("n")).join(t.features.select("feature_id", "j"), "feature_id").toPandas()
    m = t.obs.select("sample_id").distinct().count()
    prior = P.minimal_prior(o["distribution"].to_numpy(), 3, ((o["j"] % 5 - 2) / 10).to_numpy(float), o["v"].to_numpy(float), o["n"].to_numpy(float), m)
    return t.spark.createDataFrame([(d, round(float(w[0]), 5)) for d, w in prior.weight.items()], "distribution string, w double")


# ---------------------------------------------------------------- optimisers


@query(ctes(CELLS, FEATURES, Y) + """, a AS (SELECT k, feature_id, v AS p0, v * v AS a1 FROM y), b AS (SELECT *, p0 - 0.5 * p0 / (sqrt(a1) + 1e-8) AS p1 FROM a), c AS (SELECT *, a1 + p1 * p1 AS a2 FROM b),
    d AS (SELECT *, p1 - 0.5 * p1 / (sqrt(a2) + 1e-8) AS p2 FROM c), e AS (SELECT *, a2 + p2 * p2 AS a3 FROM d) SELECT CAST(k AS INTEGER) AS k, feature_id, round(p2 - 0.5 * p2 / (sqrt(a3) + 1e-8), 6) AS p FROM e""")
def adagrad_steps(t):
    """Three steps on 1/2 p^2."""
    ids = sorted(x[0] for x in t.features.select("feature_id").collect())
    p, opt = {"y": E.long_to_array(t.y(), "feature_id", 3)}, O.AdaGrad(0.5)
    for _ in range(3):
        opt.step(p, {"y": p["y"].copy()})
    return t.spark.createDataFrame([(k, f, round(float(p["y"][k, i]), 6) + 0.0) for k in range(3) for i, f in enumerate(ids)], "k int, feature_id string, p double")


@query(ctes(CELLS, FEATURES, Y) + """, a AS (SELECT k, feature_id, abs(v) AS p0, abs(v) - 0.5 AS g1 FROM y), b AS (SELECT *, 1e-8 + g1 * g1 AS s1 FROM a),
    c AS (SELECT *, greatest(greatest(p0 - 0.2 / sqrt(s1) * g1, 0) - 0.1 * 0.2 / sqrt(s1), 0) AS p1 FROM b), d AS (SELECT *, p1 - 0.5 AS g2, s1 + (p1 - 0.5) * (p1 - 0.5) AS s2 FROM c)
    SELECT CAST(k AS INTEGER) AS k, feature_id, round(greatest(greatest(p1 - 0.2 / sqrt(s2) * g2, 0) - 0.1 * 0.2 / sqrt(s2), 0), 5) AS p FROM d""")
def ista_steps(t):
    """Two steps on 1/2 (p - 1/2)^2 + |p| / 10, p >= 0."""
    ids = sorted(x[0] for x in t.features.select("feature_id").collect())
    p = np.abs(E.long_to_array(t.y(), "feature_id", 3)).T
    ssq = np.full_like(p, 1e-8)
    for _ in range(2):
        p = O.ista_nonnegative(p, p - 0.5, ssq, np.full(3, 0.1), 0.2)
    return t.spark.createDataFrame([(k, f, round(float(p[i, k]), 5)) for k in range(3) for i, f in enumerate(ids)], "k int, feature_id string, p double")


@query("SELECT r_regionkey, pow(2, -ceil(log2(1 + 2 * r_regionkey))) AS rate FROM region")
def halved_rates(t):
    def run(limit: float):
        return lambda rate, epoch: {"term_code": "loss_increase" if rate > limit else "max_epochs", "epochs": epoch + 1}

    keys = sorted(x[0] for x in t.region.select("r_regionkey").collect())
    return t.spark.createDataFrame([(k, O.with_halving(run(1 / (1 + 2 * k)))["rate"]) for k in keys], "r_regionkey int, rate double")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 2) AS x FROM customer GROUP BY 1")
def lbfgs_minimum(t):
    rows = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s")).orderBy("c_mktsegment").collect()
    n, s = (np.array([x[c] for x in rows], float) for c in ("n", "s"))
    x, _ = O.lbfgs(lambda x: (float((n * x * x / 2 - s * x).sum() / n.sum()), (n * x - s) / n.sum()), np.zeros(len(n)), rounds=100, rel_tol=1e-16, abs_tol=1e-16)
    return t.spark.createDataFrame([(c["c_mktsegment"], round(float(v), 2)) for c, v in zip(rows, x, strict=True)], "c_mktsegment string, x double")


@query(ctes(OBS) + "SELECT feature_id, round(sum(value) / 10000, 4) AS total, round(sum(value * value) / 1e8, 3) AS squares, count(*) AS n FROM obs GROUP BY 1")
def row_batches(t):
    """Sums of the rows of every task, added up by chunk."""
    ids = sorted(x[0] for x in t.features.select("feature_id").collect())
    rows, n = packed_rows(t.obs.withColumn("value", F.col("value") / 10000), ids), len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((n, 3))
        for b in (piece for whole in batches for piece in U.slices(whole, n)):
            d = U.dense(b, n)
            out += np.stack([np.nansum(d, axis=0), np.nansum(d * d, axis=0), np.isfinite(d).sum(axis=0)], axis=1)
        yield U.partial(U.split_rows("column", out))

    got = U.join_rows("column", U.add_up(rows.mapInArrow(run, U.SCHEMA)), (n, 3))
    return t.spark.createDataFrame([(f, round(float(v[0]), 4), round(float(v[1]), 3), int(v[2])) for f, v in zip(ids, got, strict=True)], "feature_id string, total double, squares double, n long")


_SW = ctes(CELLS, FEATURES, MEMBERS, Y) + """, s0 AS (SELECT DISTINCT view, set_id, feature_id FROM members JOIN features USING (gene)), s AS (SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY view, set_id)) AS weight FROM s0)"""


def _sets(t):
    m = _model(t)
    prior = m._set_prior(J.set_weights(J.feature_sets_by_view(t.members, t.features)))
    prior.start(3, len(m.features))
    return m, prior


@query(_SW + """, w AS (SELECT view, sum(weight) AS w FROM s GROUP BY 1), q AS (SELECT view, k, avg(v * v) AS ms, count(*) AS n FROM y GROUP BY ALL)
    SELECT view, CAST(k AS INTEGER) AS k, round(w / n / (ms - least(min(ms) OVER (PARTITION BY view), 0.8) + 0.001), 4) AS lam FROM q JOIN w USING (view)""")
def assignment_penalties(t):
    m, prior = _sets(t)
    prior.update_penalties(m.y)
    return t.spark.createDataFrame([(v, k, round(float(x), 4)) for v, lam in prior.lam.items() for k, x in enumerate(lam)], "view string, k int, lam double")


@query(_SW + "SELECT s.view, set_id, CAST(k AS INTEGER) AS k, round(sum(weight * 0.001 * (-1.001 / 0.0008 + 1.501 / (0.0008 + 0.5 * v * v))), 4) AS g FROM s JOIN y USING (feature_id) GROUP BY ALL")
def assignment_gradient(t):
    """The gamma-normal loss' gradient in the assignment, at none."""
    m, prior = _sets(t)
    rows = []
    for view, (cols, s) in prior.sets.items():
        g = P.gamma_normal(prior.assign[view], s, m.y[:, cols], prior.alpha, prior.alpha0, prior.v0)[1]
        rows += [(view, n, k, round(float(g[i, k]), 4)) for i, n in enumerate(prior.names[view]) for k in range(3)]
    return t.spark.createDataFrame(rows, "view string, set_id string, k int, g double")


_PROJECT = ctes(OBS, FEATURES, Y) + """, d AS (SELECT sample_id, feature_id, value / 10000 AS z FROM obs WHERE value > 40000), p AS (SELECT d.*, a.v AS y0, b.v AS y1 FROM d JOIN y a ON a.feature_id = d.feature_id AND a.k = 0 JOIN y b ON b.feature_id = d.feature_id AND b.k = 1),
    s AS (SELECT sample_id, sum(y0 * y0) AS a, sum(y0 * y1) AS b, sum(y1 * y1) AS c, sum(y0 * z) AS p, sum(y1 * z) AS q FROM p GROUP BY 1)
    SELECT sample_id, round((p * c - q * b) / (a * c - b * b), 3) AS x0, round((q * a - p * b) / (a * c - b * b), 3) AS x1 FROM s"""


def _projected(x):
    return x.select(F.col("sample_id").cast("long").alias("sample_id"), r(F.col("x")[0], 3).alias("x0"), r(F.col("x")[1], 3).alias("x1"))


def _gappy(t):
    return t.obs.where("value > 40000").withColumn("value", F.col("value") / 10000)


@query(_PROJECT)
def linear_transform(t):
    ids = sorted(x[0] for x in t.features.select("feature_id").collect())
    return _projected(BL.linear_transform(BL.wide_rows(_gappy(t), ids), E.long_to_array(t.y(2), "feature_id", 2)))


@query(_PROJECT)
def transformed_samples(t):
    """New samples on given factors, with the model's own solver."""
    return _projected(_model(t, 2, plain=True).transform(_gappy(t)))


# ---------------------------------------------------------------- fits


@query(ctes(OBS, FEATURES) + _DISC + """, m AS (SELECT feature_id, distribution, avg(d) AS m, stddev_pop(d) AS s FROM o GROUP BY ALL)
    SELECT feature_id, round(CASE distribution WHEN 'bernoulli' THEN ln(greatest(least(m, 0.999), 0.001) / (1 - greatest(least(m, 0.999), 0.001))) WHEN 'poisson' THEN ln(greatest(m, 0.001)) ELSE m END, 5) AS mu,
        round(CASE WHEN distribution = 'normal' AND s > 0 THEN ln(s) ELSE 0 END, 5) + 0.0::DOUBLE AS logsigma FROM m""")
def start_values(t):
    m = FactorModel(3)
    m._start(_typed(t).withColumn("value", F.col("d")), t.features.select("feature_id", "view", "distribution"), 0, False)
    f = t.spark.createDataFrame(m.features[["feature_id", "mu", "logsigma"]])
    return f.select("feature_id", r("mu", 5).alias("mu"), (r("logsigma", 5) + 0.0).alias("logsigma"))


_FITS: dict[tuple, FactorModel] = {}


def _fitted(t, prior: str = "l2") -> FactorModel:
    """One fit for each session, folder and prior, to the operator's own tolerance."""
    key = (t.spark.sparkContext.applicationId, t.dir, prior)
    if key not in _FITS:
        d = dense(t)
        features = d.select("feature_id", "view", F.lit("normal").alias("distribution")).distinct()
        sets = features.withColumn("set_id", F.concat("view", (F.substring("feature_id", 2, 2).cast("int") % 6).cast("string")))
        _FITS[key] = FactorModel(4, prior=prior).fit(d, d.select("sample_id", "condition").distinct(), features, sets=J.set_weights(sets.select("view", "set_id", "feature_id")) if prior == "fsard" else None)
    return _FITS[key]


def _falls(t, m: FactorModel):
    """Whether the loss of each of the first two stages ended below its start and never rose where it was kept."""
    rows = []
    for stage in ("first", "fit"):
        total = [h["total_loss"] for h in m.history if h["name"] == "epoch" and h["stage"] == stage]
        end = next(h["total_loss"] for h in m.history if h["name"] == "descended" and h["stage"] == stage)
        rows.append((stage, bool(end <= min(total) and end < total[0])))
    return t.spark.createDataFrame(rows, "stage string, falls boolean")


_STAGES = "SELECT * FROM (VALUES ('first', true), ('fit', true)) v(stage, falls)"


@query(_STAGES)
def fit_history(t):
    return _falls(t, _fitted(t))


@query(_STAGES)
def fit_ard(t):
    return _falls(t, _fitted(t, "ard"))


@query("SELECT DISTINCT CASE WHEN d < 32 THEN 'low' ELSE 'high' END AS view, 6 AS sets, true AS nonnegative, true AS fits FROM range(64) x(d)")
def fit_feature_sets(t):
    """Assignments of six sets a view, none negative; beta is what they give."""
    m = _fitted(t, "fsard")
    prior = m.y_prior
    rows = [(v, len(a), bool((a >= 0).all()), bool(np.allclose(prior.beta[:, cols], (prior.alpha0 - 1) * (prior.v0 + a.T @ s)))) for v, a in m.assign.items() for cols, s in [prior.sets[v]]]
    return t.spark.createDataFrame(rows, "view string, sets int, nonnegative boolean, fits boolean")


@query("SELECT CAST(vec_id AS VARCHAR) AS sample_id, 4 AS factors FROM embeddings")
def transform_new_samples(t):
    return _fitted(t).transform(dense(t)).select("sample_id", F.size("x").alias("factors"))


@query("SELECT CAST(vec_id AS VARCHAR) AS sample_id, 64::BIGINT AS n FROM embeddings")
def impute_model(t):
    return _fitted(t).impute().where("value is not null").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


_EM_ALL = _EM[: _EM.index(",\n    pr AS")].replace("value / 10000 AS value FROM obs", "value / 10000 + 5 * coalesce(batch_value, 0) AS value FROM obs LEFT JOIN batch_map USING (view, sample_id) LEFT JOIN batch_values USING (view, batch, feature_id)")


#: Conditions that every batch has some of; nations lie within regions, which leaves nothing to a region's shift.
_CROSSED = ("s_nationkey AS condition", "s_suppkey % 3 AS condition")


@query(ctes(OBS, FEATURES, BATCHES).replace("WITH", "WITH RECURSIVE", 1).replace(*_CROSSED) + _EM_ALL + """,
    em AS (SELECT 0 AS turn, view, batch, feature_id, n, s, q, sigma2, tl, theta, delta2 FROM st UNION ALL
        SELECT turn + 1, view, batch, feature_id, n, s, q, sigma2, tl, t, (dm * (1 + dm * dm / (dv + 1e-9)) + 0.5 * (q - 2 * t * s + n * t * t) / sigma2) / (2 + dm * dm / (dv + 1e-9) + 0.5 * n - 1)
        FROM (SELECT *, (tm * delta2 * sigma2 + tl * n * tv) / (delta2 * sigma2 + n * tv) AS t FROM (
            SELECT *, avg(theta) OVER g AS tm, coalesce(var_samp(theta) OVER g, 1) AS tv, avg(delta2) OVER g AS dm, coalesce(var_samp(delta2) OVER g, 0) AS dv FROM em WHERE turn < 100 WINDOW g AS (PARTITION BY view, batch))))
    SELECT view, batch, feature_id, round(theta, 4) + 0.0::DOUBLE AS theta, round(0.5 * ln(delta2), 4) + 0.0::DOUBLE AS logdelta FROM em WHERE turn = 100""")
def batch_effects_fit(t):
    """All 100 rounds under normal noise, with shifts planted in the values."""
    own = t.obs.join(t.batch_map, ["view", "sample_id"], "left").join(t.batch_values, ["view", "batch", "feature_id"], "left")
    o = own.select("sample_id", "feature_id", "view", (F.col("value") / 10000 + 5 * F.coalesce("batch_value", F.lit(0.0))).alias("value"))
    fitted, _ = B.fit_batch_effects(o, t.batch_map, _crossed(t), rounds=100, tolerance=-1.0)
    return fitted.select("view", "batch", "feature_id", (r("theta", 4) + 0.0).alias("theta"), (r("logdelta", 4) + 0.0).alias("logdelta"))


def _crossed(t):
    return t.samples.withColumn("condition", F.col("sample_id") % 3)


def _newton_sql(turns: int) -> str:
    """Shifts of counts by Newton steps without a prior, then one round with priors."""
    mean = "CASE distribution WHEN 'bernoulli' THEN 1 / (1 + exp(-({z}))) WHEN 'poisson' THEN exp({z}) ELSE {z} END"
    spread = "CASE distribution WHEN 'bernoulli' THEN m * (1 - m) WHEN 'poisson' THEN m ELSE 1 END"
    step = """m{n} AS (SELECT j.*, theta, {mean} AS m FROM j JOIN t{n} USING (view, batch, feature_id)),
        w{n} AS (SELECT view, batch, feature_id, any_value(distribution) AS distribution, any_value(theta) AS theta, sum(n * m - s) AS g, sum(n * {spread}) AS h, sum((q - 2 * m * s + n * m * m) / {spread}) AS qq, sum(n) AS n FROM m{n} GROUP BY ALL)"""
    sums = lambda n: step.format(n=n, mean=mean.format(z="z0 + theta"), spread=f"({spread})")
    out = ["t0 AS (SELECT view, batch, feature_id, 0.0::DOUBLE AS theta FROM j GROUP BY ALL)"]
    for n in range(turns):
        out += [sums(n), f"t{n + 1} AS (SELECT view, batch, feature_id, theta + CASE WHEN distribution = 'normal' THEN -g / greatest(h, 1e-9) ELSE greatest(-1, least(1, -g / greatest(h, 1e-9))) END AS theta FROM w{n})"]
    last = turns
    out += [sums(last), f"""e AS (SELECT *, avg(theta) OVER g AS tm, coalesce(var_samp(theta) OVER g, 1) AS tv, avg(d2) OVER g AS dm, coalesce(var_samp(d2) OVER g, 0) AS dv
            FROM (SELECT w.*, sigma2, coalesce(nullif(qq / n / sigma2, 0), 1) AS d2 FROM w{last} w JOIN s2 USING (feature_id)) WINDOW g AS (PARTITION BY view, batch))""",
        f"""t{last + 1} AS (SELECT view, batch, feature_id, theta + CASE WHEN distribution = 'normal' THEN u - theta ELSE greatest(-1, least(1, u - theta)) END AS theta
            FROM (SELECT *, (tm * d2 * sigma2 + (theta * h - g) * tv) / (d2 * sigma2 + h * tv) AS u FROM e))""", sums(last + 1)]  # fmt: skip
    base = "CASE distribution WHEN 'bernoulli' THEN ln((sum(s) + 0.5) / (sum(n) - sum(s) + 0.5)) WHEN 'poisson' THEN ln((sum(s) + 0.5) / sum(n)) ELSE sum(s) / sum(n) END"
    return f"""{ctes(OBS, FEATURES, SAMPLES).replace(*_CROSSED) + _DISC}, bm AS (SELECT v AS view, sample_id, region AS batch FROM samples, (VALUES ('A'), ('N'), ('R')) AS t(v)),
        c AS (SELECT view, batch, feature_id, condition, distribution, count(d)::DOUBLE AS n, sum(d) AS s, sum(d * d) AS q FROM o JOIN samples USING (sample_id) LEFT JOIN bm USING (view, sample_id) WHERE d IS NOT NULL GROUP BY ALL),
        b AS (SELECT feature_id, condition, {base} AS z0 FROM c GROUP BY feature_id, condition, distribution), j AS (SELECT * FROM c JOIN b USING (feature_id, condition)),
        s2 AS (SELECT feature_id, coalesce(nullif(sum((q - 2 * m * s + n * m * m) / {spread}) / sum(n), 0), 1) AS sigma2 FROM (SELECT *, {mean.format(z="z0")} AS m FROM j) GROUP BY 1),
        {', '.join(out)}
        SELECT view, batch, feature_id, round(w.theta, 4) + 0.0::DOUBLE AS theta, round(0.5 * ln((dm * (1 + dm * dm / (dv + 1e-9)) + 0.5 * w.qq / sigma2) / (2 + dm * dm / (dv + 1e-9) + 0.5 * w.n - 1)), 4) + 0.0::DOUBLE AS logdelta
        FROM w{last + 1} w JOIN e USING (view, batch, feature_id)"""


@query(_newton_sql(4))
def batch_effects_counts(t):
    """Shifts of 0/1, count and normal views: four Newton steps without a prior, one round with priors."""
    o = _typed(t).select("sample_id", "feature_id", "view", F.col("d").alias("value"))
    batches = t.samples.select(F.explode(F.array(*map(F.lit, "ANR"))).alias("view"), "sample_id", F.col("region").alias("batch"))
    fitted, _ = B.fit_batch_effects(o, batches, _crossed(t), t.features, rounds=1, newton=4)
    return fitted.select("view", "batch", "feature_id", (r("theta", 4) + 0.0).alias("theta"), (r("logdelta", 4) + 0.0).alias("logdelta"))


@query(ctes(OBS, FEATURES, BATCHES, Y) + """, w AS (SELECT view, feature_id, v FROM y WHERE k = 0),
    p AS (SELECT o.sample_id, o.view, batch, o.feature_id, value / 10000 AS d, v, exp((j % 5 - 2) / 10.0::DOUBLE + coalesce((batch - 2) / 20.0::DOUBLE, 0)) AS s, (j % 7 - 3) / 10.0::DOUBLE + coalesce((batch - 2) / 4.0::DOUBLE, 0) AS c
        FROM obs o JOIN features USING (feature_id) JOIN w USING (feature_id) LEFT JOIN batch_map m ON m.view = o.view AND m.sample_id = o.sample_id),
    x AS (SELECT sample_id, sum(v * s * (d - c)) / (sum(v * v * s * s) + 1 + 1e-8) AS x FROM p GROUP BY 1),
    g AS (SELECT view, batch, feature_id, x * v * s + c - d AS g, x * v * s AS u FROM p JOIN x USING (sample_id))
    SELECT 'mu' AS layer, view, NULL::VARCHAR AS batch, feature_id, round(sum(g), 4) + 0.0::DOUBLE AS slope, round(sum(1), 4)::DOUBLE AS curvature FROM g GROUP BY ALL
    UNION ALL SELECT 'logsigma', view, NULL, feature_id, round(sum(g * u), 4) + 0.0::DOUBLE, round(sum(u * u), 4) FROM g GROUP BY ALL
    UNION ALL SELECT 'theta', view, CAST(batch AS VARCHAR), feature_id, round(sum(g), 4) + 0.0::DOUBLE, round(sum(1), 4)::DOUBLE FROM g WHERE batch IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'logdelta', view, CAST(batch AS VARCHAR), feature_id, round(sum(g * u), 4) + 0.0::DOUBLE, round(sum(u * u), 4) FROM g WHERE batch IS NOT NULL GROUP BY ALL""")
def layer_gradients(t):
    """One pass over all samples, each solved at one factor: slope and curvature of the loss in every layer."""
    m = _model(t, 1)
    m.features["distribution"] = "normal"
    b = F.col("batch") - 2
    own = t.obs.join(t.batch_map, ["view", "sample_id"]).select("view", "batch", "feature_id").distinct()
    m.batches = BatchLayers.of(own.select("view", "batch", "feature_id", (b / 4.0).alias("theta"), (b / 20.0).alias("logdelta")), m.features)
    m.x_prior = P.SamplePrior(np.ones(1))
    o = t.obs.select("sample_id", "feature_id", "view", (F.col("value") / 10000).alias("value"))
    s = m._pass(m.rows(o, batch_map=t.batch_map))
    f, parts = m.features, []
    for layer in ("mu", "logsigma"):
        parts.append(pd.DataFrame({"layer": layer, "view": f["view"], "batch": None, "feature_id": f["feature_id"], "slope": s.layers[layer][0], "curvature": s.layers[layer][1]}))
    for layer in ("theta", "logdelta"):
        parts.append(m.batches.frame(f)[["view", "batch", "feature_id"]].assign(layer=layer, slope=s.layers[layer][0], curvature=s.layers[layer][1]))
    all_ = t.spark.createDataFrame(pd.concat(parts, ignore_index=True)[["layer", "view", "batch", "feature_id", "slope", "curvature"]], "layer string, view string, batch string, feature_id string, slope double, curvature double")
    seen = own.select("view", F.col("batch").cast("string").alias("batch"), "feature_id")
    shown = all_.where("batch is null").unionByName(all_.join(seen, ["view", "batch", "feature_id"], "left_semi"))
    return shown.select("layer", "view", "batch", "feature_id", (r("slope", 4) + 0.0).alias("slope"), r("curvature", 4).alias("curvature"))


_ONE = """, w AS (SELECT feature_id, v FROM y WHERE k = 0), x0 AS (SELECT sample_id, v AS x FROM x WHERE k = 0),
    p AS (SELECT sample_id, feature_id, value / 10000 AS d, v, exp((j % 5 - 2) / 10.0::DOUBLE) AS s, (j % 7 - 3) / 10.0::DOUBLE AS c FROM obs JOIN features USING (feature_id) JOIN w USING (feature_id))"""


def _one_factor(t, **columns: int):
    """A model of one factor and normal noise, and its rows with a deterministic x and some zeros."""
    m = _model(t, 1)
    m.features["distribution"] = "normal"
    o = t.obs.select("sample_id", "feature_id", "view", (F.col("value") / 10000).alias("value"))
    return m, DE.with_state(m.rows(o), m.factors, **columns)


def _adagrad_sql(steps: int) -> str:
    """Each step: slopes of all rows at x, the sum of squares a, the step."""
    out = ["x0_ AS (SELECT sample_id, x, 0.0::DOUBLE AS a FROM x0)"]
    for n in range(steps):
        out.append(f"g{n} AS (SELECT sample_id, any_value(x) AS x, any_value(a) AS a, sum((x * v * s + c - d) * v * s) + any_value(x) AS g FROM p JOIN x{n}_ USING (sample_id) GROUP BY 1)")
        out.append(f"x{n + 1}_ AS (SELECT sample_id, x - 0.5 * g / (sqrt(a + g * g) + 1e-8) AS x, a + g * g AS a FROM g{n})")
    return f"{ctes(OBS, FEATURES, SAMPLES, X, Y) + _ONE}, {', '.join(out)} SELECT sample_id, round(x, 5) + 0.0::DOUBLE AS x, round(a, 3) AS squares FROM x{steps}_"


@query(_adagrad_sql(3))
def adagrad_rows(t):
    """Three steps on the factors of all samples; their sums of squares stay beside them."""
    m, state = _one_factor(t, acc=1)
    out, _, _ = DE.fit_adagrad(state, m._columns(), P.SamplePrior(np.ones(1)), epochs=3, rate=0.5, tolerance=-1.0)
    return out.select(F.col("sample_id").cast("long").alias("sample_id"), (r(F.col("x")[0], 5) + 0.0).alias("x"), r(F.col("acc")[0], 3).alias("squares"))


@query(ctes(OBS, FEATURES, SAMPLES, X, Y) + _ONE + " SELECT sample_id, round(sum((d - c) * v * s) / (sum(v * v * s * s) + 1), 4) + 0.0::DOUBLE AS x FROM p GROUP BY 1")
def lbfgs_rows(t):
    """Factors of all samples at the minimum, which has a closed form."""
    m, state = _one_factor(t, g=1, past=0)
    out, _, _ = DE.fit_lbfgs(state, m._columns(), P.SamplePrior(np.ones(1)), rel_tol=1e-15, abs_tol=0.0)
    return out.select(F.col("sample_id").cast("long").alias("sample_id"), (r(F.col("x")[0], 4) + 0.0).alias("x"))


# ---------------------------------------------------------------- splits, simulation, baselines


@query("SELECT c_nationkey AS batch, 1::BIGINT AS splits, count(*) AS n FROM customer GROUP BY 1")
def stratified_group_split(t):
    s = t.customer.select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_nationkey").alias("batch"), "c_mktsegment")
    return D.stratified_group_split(s, "batch", "c_mktsegment", [0.75, 0.25], seed=1).groupBy("batch").agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("n"))


@query("SELECT least(50, count(*)) AS n, least(50, count(*)) AS distinct_n FROM customer")
def random_sample(t):
    s = D.sample_rows(t.customer.select("c_custkey", F.greatest("c_acctbal", F.lit(1.0)).alias("w")), 50, "c_custkey", seed=2, weight="w")
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("distinct_n"))


@query(ctes(CELLS, FEATURES) + "SELECT least(20, count(*)) AS n, least(20, sum(CASE WHEN gene IN ('Brand#1', 'Brand#2') THEN 1 ELSE 0 END)) AS listed FROM features")
def feature_subset(t):
    genes = t.spark.createDataFrame([("Brand#1",), ("Brand#2",)], "gene string")
    s = D.feature_subset(t.features, genes, 20, seed=3)
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gene").isin("Brand#1", "Brand#2").cast("long")).alias("listed"))


@query(ctes(CELLS, FEATURES, SAMPLES) + "SELECT view, count(*) * (SELECT count(*) FROM samples) AS n FROM features GROUP BY 1")
def simulated_obs(t):
    f = SM.column_values(t.features.select("feature_id", "view", "distribution"), 3, seed=3)
    return SM.simulate_data(SM.factor_values(t.samples, "sample_id", 3, 1), SM.factor_values(t.features, "feature_id", 3, 2), f, seed=4).groupBy("view").agg(F.count("value").alias("n"))


@query(ctes(CELLS, FEATURES, SAMPLES, BATCHES.split(",\n", 1)[1]) + """SELECT 'X' AS name, count(*) * 3 AS n FROM samples UNION ALL SELECT 'Y', count(*) * 3 FROM features UNION ALL SELECT 'features', count(*) FROM features
    UNION ALL SELECT 'theta', count(*) FROM batch_values UNION ALL SELECT 'obs', (SELECT count(*) FROM samples) * (SELECT count(*) FROM features)""")
def simulated_study(t):
    tables = SM.study(t.samples.select("sample_id"), t.features.select("feature_id", "view", "distribution"), 3, t.batch_map, seed=7)
    return t.spark.createDataFrame([(n, df.count()) for n, df in tables.items()], "name string, n long")


@query(ctes(CELLS, FEATURES, MEMBERS) + """, s AS (SELECT view, set_id, count(DISTINCT feature_id) AS n FROM members JOIN features USING (gene) GROUP BY ALL), v AS (SELECT view, count(*) AS all FROM features GROUP BY 1)
    SELECT view, set_id, CAST(n - round_even(0.2::DOUBLE * n, 0) + least(round_even(0.2::DOUBLE * n, 0), v.all - n) AS BIGINT) AS n FROM s JOIN v USING (view)""")
def corrupted_sets(t):
    return SM.corrupt_sets(J.feature_sets_by_view(t.members, t.features), t.features, 0.2, 0.2, seed=1).groupBy("view", "set_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round((1 + abs(corr(l_quantity, l_extendedprice))) / 2, 4) AS share FROM lineitem")
def pca_two_columns(t):
    """The first component of two standardised columns explains (1 + |correlation|) / 2; each row with both values is a sample."""
    _, share = BL.pca_columns(t.lineitem, ["l_quantity", "l_extendedprice"], 1)
    return t.spark.createDataFrame([(round(float(share[0]), 4) if len(share) else None,)], "share double")


@query("SELECT view, 3::BIGINT AS components, true AS orthonormal FROM (VALUES ('low'), ('high')) v(view)")
def pca_components(t):
    out = BL.pca_baseline(dense(t), 3)
    views = list(dict.fromkeys(out["views"]))
    return t.spark.createDataFrame([(v, len(y), bool(np.allclose(y @ y.T, np.eye(len(y)), atol=1e-6))) for v, (y, _) in zip(views, out["blocks"], strict=True)], "view string, components long, orthonormal boolean")


@query(ctes(OBS, FEATURES, SAMPLES) + """, o AS (SELECT * FROM obs WHERE value > 40000), v AS (SELECT view, feature_id, var_samp(value) AS variance, count(*) AS n FROM o GROUP BY ALL HAVING count(*) > 2),
    c AS (SELECT view, quantile_cont(variance, 0.5) AS cut FROM v GROUP BY 1), k AS (SELECT feature_id FROM v JOIN c USING (view) WHERE variance >= cut), m AS (SELECT feature_id, median(value) AS median FROM o JOIN k USING (feature_id) GROUP BY 1)
    SELECT s.sample_id, m.feature_id, round(coalesce(o.value, m.median), 4) AS value FROM samples s CROSS JOIN m LEFT JOIN o ON o.sample_id = s.sample_id AND o.feature_id = m.feature_id""")
def raw_baseline(t):
    grid, _ = BL.raw_baseline(t.obs.where("value > 40000"), t.samples, 2, 0.5)
    return grid.withColumn("value", r("value", 4))


@query(ctes(OBS, FEATURES, MEMBERS) + """, s AS (SELECT DISTINCT set_id, feature_id FROM members JOIN features USING (gene)),
    k AS (SELECT sample_id, feature_id, (rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0 - (count(*) OVER (PARTITION BY sample_id) + 1) / 2.0) / count(*) OVER (PARTITION BY sample_id) AS r FROM obs)
    SELECT sample_id, set_id, round(avg(r), 6) + 0.0::DOUBLE AS score FROM k JOIN s USING (feature_id) GROUP BY ALL""")
def sample_set_scores(t):
    return BL.sample_rank_scores(t.obs, J.feature_sets_by_view(t.members, t.features)).withColumn("score", r("score") + 0.0)


_PHI = "CASE WHEN {x} < 0 THEN {q} / 2 ELSE 1 - {q} / 2 END"
_TAIL = "({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-pow({x} / sqrt(2), 2)))"


def _gsva_sql() -> str:
    x = "((e.bin - c.bin - 0.5) / 4.0::DOUBLE)"
    phi = _PHI.format(x=x, q=_TAIL.format(x=x, t=f"(1 / (1 + 0.3275911::DOUBLE * abs({x}) / sqrt(2)))"))
    return ctes(OBS, FEATURES, MEMBERS) + f""", f AS (SELECT feature_id, min(value) AS low, stddev_samp(value) / 16 AS width FROM obs GROUP BY 1 HAVING width > 0),
        v AS (SELECT sample_id, feature_id, (value - low) / width AS whereabouts, CAST(floor((value - low) / width) AS BIGINT) AS bin FROM obs JOIN f USING (feature_id)),
        c AS (SELECT feature_id, bin, count(*)::DOUBLE AS n FROM v GROUP BY ALL), e AS (SELECT feature_id, bin FROM c UNION SELECT feature_id, bin + 1 FROM c),
        s AS (SELECT e.feature_id, e.bin, sum(c.n * CASE WHEN c.bin < e.bin - 24 THEN 1 WHEN c.bin > e.bin + 24 THEN 0 ELSE {phi} END) / sum(c.n) AS f FROM e JOIN c USING (feature_id) GROUP BY ALL),
        z AS (SELECT sample_id, v.feature_id, a.f + (whereabouts - v.bin) * (b.f - a.f) AS z FROM v JOIN s a ON a.feature_id = v.feature_id AND a.bin = v.bin JOIN s b ON b.feature_id = v.feature_id AND b.bin = v.bin + 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY z DESC, feature_id) AS place, count(*) OVER (PARTITION BY sample_id) AS p FROM z),
        g AS (SELECT DISTINCT set_id, feature_id FROM members JOIN features USING (gene)), ss AS (SELECT DISTINCT set_id FROM g),
        w AS (SELECT k.sample_id, ss.set_id, k.place, g.feature_id IS NOT NULL AS inside, abs(k.p / 2 - k.place + 1) AS w FROM k CROSS JOIN ss LEFT JOIN g ON g.set_id = ss.set_id AND g.feature_id = k.feature_id),
        t AS (SELECT *, sum(CASE WHEN inside THEN w ELSE 0 END) OVER p / nullif(sum(CASE WHEN inside THEN w ELSE 0 END) OVER a, 0) AS i, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER p / nullif(sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER a, 0) AS o, sum(inside::INT) OVER a AS m
            FROM w WINDOW a AS (PARTITION BY sample_id, set_id), p AS (PARTITION BY sample_id, set_id ORDER BY place))
        SELECT sample_id, set_id, round(greatest(max(coalesce(i, 0) - coalesce(o, 0)), 0) + least(min(coalesce(i, 0) - coalesce(o, 0)), 0), 4) + 0.0::DOUBLE AS score FROM t WHERE m > 0 GROUP BY ALL"""


@query(_gsva_sql())
def set_variation_scores(t):
    """The SQL walks over all features of a sample for each set, not only the set's."""
    return BL.gsva(t.obs, J.feature_sets_by_view(t.members, t.features)).withColumn("score", r("score", 4) + 0.0)


_MANY = "(SELECT CAST(l_linenumber % 4 AS INTEGER) AS y, [((l_orderkey * 7 + l_partkey * (3 + i) + l_linenumber * i) % 50 + CASE WHEN l_linenumber % 4 = i THEN 9 ELSE 0 END)::DOUBLE FOR i IN range(4)] AS s FROM lineitem)"
_AREA = "(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))"


@query(f"""WITH d AS {_MANY}, k AS (SELECT DISTINCT y AS a FROM d),
    r AS (SELECT a, (y = a)::INT AS y, s[a + 1] AS p FROM d CROSS JOIN k), rr AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY p) + (count(*) OVER (PARTITION BY a, p) - 1) / 2.0 AS r FROM r),
    o AS (SELECT a.a, b.a AS b, (y = a.a)::INT AS y, s[a.a + 1] AS p FROM d JOIN k a ON true JOIN k b ON a.a <> b.a AND (d.y = a.a OR d.y = b.a)), oo AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY p) + (count(*) OVER (PARTITION BY a, b, p) - 1) / 2.0 AS r FROM o)
    SELECT (SELECT round(avg(auc), 6) FROM (SELECT {_AREA} AS auc FROM rr GROUP BY a)) AS auc_ovr, (SELECT round(avg(auc), 6) FROM (SELECT {_AREA} AS auc FROM oo GROUP BY a, b)) AS auc_ovo""")
def multiclass_auc(t):
    s = F.array(*((F.pmod(F.col("l_orderkey") * 7 + F.col("l_partkey") * (3 + i) + F.col("l_linenumber") * i, F.lit(50)) + F.when(F.col("l_linenumber") % 4 == i, 9).otherwise(0)).cast("double") for i in range(4)))
    return E.multiclass_auc(t.lineitem.select((F.col("l_linenumber") % 4).cast("int").alias("y"), s.alias("s")), "y", "s").select(r("auc_ovr").alias("auc_ovr"), r("auc_ovo").alias("auc_ovo"))


@query(ctes(OBS, FEATURES, SAMPLES, X, Y) + _ONE + " SELECT sample_id, count(*) AS n, round(sum((d - c) * v * s) / (sum(v * v * s * s) + 1e-8), 4) + 0.0::DOUBLE AS x FROM p GROUP BY 1")
def streamed_samples(t):
    """Factors of samples whose values come in several micro-batches."""
    m, _ = _one_factor(t)
    source, sink, checkpoint = (new_path(t.spark, name) for name in ("stream-in", "stream-out", "stream-state"))
    o = t.obs.select(F.col("sample_id").cast("string").alias("sample_id"), "feature_id", (F.col("value") / 10000).alias("value"))
    o.repartition(3, "feature_id").write.parquet(source)
    q = transform_split_stream(m, t.spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(source), sink, checkpoint)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return latest_factors(t.spark, sink).select(F.col("sample_id").cast("long").alias("sample_id"), "n", (r(F.col("x")[0], 4) + 0.0).alias("x"))


def _gamma_sql(shape: float, tries: int) -> str:
    d = shape - 1 / 3
    u = "(((o_orderkey * 7919 + {i} * 10473 + {a}) % 9973 + 0.5) / 9973.0::DOUBLE)"
    x = [f"sqrt(-2 * ln({u.format(i=i, a=1)})) * cos(2 * pi() * {u.format(i=i, a=5003)})" for i in range(tries)]
    v = [f"pow(1 + ({w}) / sqrt({9 * d!r}::DOUBLE), 3)" for w in x]
    pairs = [f"CASE WHEN {c} > 0 AND ln({u.format(i=i, a=2741)}) < 0.5 * pow({w}, 2) + {d!r}::DOUBLE - {d!r}::DOUBLE * {c} + {d!r}::DOUBLE * ln(greatest({c}, 1e-300)) THEN {d!r}::DOUBLE * {c} END" for i, (w, c) in enumerate(zip(x, v, strict=True))]
    return f"SELECT o_orderkey, round(coalesce({', '.join(pairs)}, {d!r}::DOUBLE), 5) AS g FROM orders"


@query(_gamma_sql(1.01, 6))
def gamma_variates(t):
    """Gamma variates from given normal and uniform draws, rejected ones skipped."""
    u = lambda i, a: (F.pmod(F.col("o_orderkey") * 7919 + i * 10473 + a, F.lit(9973)) + 0.5) / 9973.0
    x = lambda i: F.sqrt(-2 * F.ln(u(i, 1))) * F.cos(2 * np.pi * u(i, 5003))
    return t.orders.select("o_orderkey", r(SM.gamma_from(1.01, [x(i) for i in range(6)], [u(i, 2741) for i in range(6)]), 5).alias("g"))


_EDGES = [-0.2, -0.1, 0.0, 0.1, 0.2]


@query(f"""WITH d AS (SELECT vec_id, embedding[1:8] AS x, vec_id * 7919 % 20 + 1 AS t0, vec_id % 3 <> 0 AS dead FROM embeddings), b AS (SELECT vec_id, x, dead, CASE WHEN x[4] > 0.05 THEN t0 // 2 + 1 ELSE t0 END AS time FROM d),
    f AS (SELECT vec_id, time, dead, j, CAST(x[j + 1] AS DOUBLE) AS v FROM b, range(8) AS r(j)), e AS (SELECT unnest(range(5)) AS c, unnest({_EDGES}::DOUBLE[]) AS edge), ts AS (SELECT unnest(range(1, 21)) AS t),
    n AS (SELECT j, c, t, count(*) FILTER (time >= t)::DOUBLE AS y, count(*) FILTER (time >= t AND v <= edge)::DOUBLE AS yl, count(*) FILTER (time = t AND dead)::DOUBLE AS d, count(*) FILTER (time = t AND dead AND v <= edge)::DOUBLE AS dl, count(*) FILTER (v <= edge) AS nl, count(*) AS nn FROM f, e, ts GROUP BY ALL),
    s AS (SELECT j, c, pow(sum(dl - CASE WHEN y > 0 THEN yl / y * d ELSE 0 END), 2) / nullif(sum(CASE WHEN y > 1 THEN yl / y * (1 - yl / y) * (y - d) / (y - 1) * d ELSE 0 END), 0) AS value FROM n WHERE nl >= 15 AND nn - nl >= 15 GROUP BY ALL),
    best AS (SELECT * FROM s WHERE value > 0 ORDER BY value DESC, j, c LIMIT 1),
    side AS (SELECT vec_id, time, dead, j, c, value, v <= edge AS l FROM f JOIN best USING (j) JOIN e USING (c)),
    h AS (SELECT l, sum(d / y * (21 - t)) AS risk FROM (SELECT l, t, count(*) FILTER (time >= t)::DOUBLE AS y, count(*) FILTER (time = t AND dead)::DOUBLE AS d FROM side, ts GROUP BY ALL) WHERE y > 0 GROUP BY 1)
    SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(j AS INTEGER) AS feature, CAST(c AS INTEGER) AS cut, round(value, 4) AS statistic, round(risk, 4) AS risk FROM side JOIN h USING (l)""")
def survival_tree(t):
    """One tree of one cut on all samples: its log-rank statistic, and every sample's expected deaths."""
    x = F.slice("embedding", 1, 8)
    start = F.col("vec_id") * 7919 % 20 + 1
    rows = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.when(x[3] > 0.05, F.floor(start / 2) + 1).otherwise(start).alias("time"), (F.col("vec_id") % 3 != 0).cast("int").alias("event"), x.alias("x"))
    forest = SV.fit_survival_forest(rows, [np.array(_EDGES)] * 8, np.arange(1.0, 21.0), trees=1, depth=1, tries=8, bootstrap=False)
    (j, cut), value = forest.splits[0][1], forest.statistics[0][1]
    return forest.predict(rows).select("sample_id", F.lit(j).alias("feature"), F.lit(cut).alias("cut"), F.lit(round(value, 4)).alias("statistic"), r("risk", 4).alias("risk"))


def _labelled(t):
    from pyspark.ml.functions import array_to_vector

    return t.embeddings.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))


@query()
def forest_predictions(t):
    """Predictions of a fifth of the rows by a forest of 500 trees fitted on the others."""
    d = _labelled(t)
    model = BL.random_forest(t.spark, d.where("vec_id % 5 <> 0"), "label")
    return model.transform(d.where("vec_id % 5 = 0")).select("vec_id", "label", "prediction")


@query("SELECT count(*) AS n, 0::BIGINT AS differ FROM embeddings")
def forest_round_trip(t):
    from pyspark.ml.classification import RandomForestClassificationModel

    d, path = _labelled(t), new_path(t.spark, "forest")
    model = BL.random_forest(t.spark, d, "label", trees=10)
    model.write().overwrite().save(path)
    back = RandomForestClassificationModel.load(path)
    both = model.transform(d).select("vec_id", F.col("prediction").alias("a")).join(back.transform(d).select("vec_id", F.col("prediction").alias("b")), "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("differ"))


# ---------------------------------------------------------------- scores


_COS = ctes(CELLS, FEATURES) + """, y4 AS (SELECT feature_id, k, ((j * 6101 + k * 3571 + 29) % 1000) / 500.0::DOUBLE - 1 AS v FROM features, range(4) r(k)),
    n AS (SELECT k, sum(v * v) AS n FROM y4 GROUP BY 1), c AS (SELECT a.k AS i, b.k AS j, pow(sum(a.v * b.v), 2) / max(x.n) / max(z.n) AS c FROM y4 a JOIN y4 b USING (feature_id) JOIN n x ON x.k = a.k JOIN n z ON z.k = b.k WHERE a.k < 3 GROUP BY ALL),
    m AS (SELECT a.j AS j0, b.j AS j1, d.j AS j2, a.c + b.c + d.c AS total FROM c a, c b, c d WHERE a.i = 0 AND b.i = 1 AND d.i = 2 AND a.j <> b.j AND a.j <> d.j AND b.j <> d.j), best AS (SELECT * FROM m ORDER BY total DESC LIMIT 1) """


@query(_COS + "SELECT round(total / 3, 6) AS match FROM best")
def span_similarity(t):
    a, b = (E.long_to_array(t.y(k), "feature_id", k) for k in (3, 4))
    return t.spark.createDataFrame([(round(E.best_match(E.squared_cosines(a, b)), 6),)], "match double")


@query(_COS + "SELECT 0 AS i, CAST(j0 AS INTEGER) AS j FROM best UNION ALL SELECT 1, j1 FROM best UNION ALL SELECT 2, j2 FROM best")
def factor_assignment(t):
    a, b = (E.long_to_array(t.y(k), "feature_id", k) for k in (3, 4))
    return t.spark.createDataFrame(J.assignment(E.squared_cosines(a, b)), "i int, j int")


_POS = "p AS (SELECT k, v, j % 3 = 0 AS pos FROM y)"
_AUC = ctes(CELLS, FEATURES, Y, _POS) + """, a AS (SELECT a.k, avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS auc FROM p a JOIN p b ON a.k = b.k AND a.pos AND NOT b.pos GROUP BY 1),
    g AS (SELECT k, v, sum(pos::INT) AS tp, count(*) AS n FROM p GROUP BY ALL), w AS (SELECT *, sum(tp) OVER o AS ctp, sum(n) OVER o AS cn, sum(tp) OVER (PARTITION BY k) AS all FROM g WINDOW o AS (PARTITION BY k ORDER BY v DESC)),
    b AS (SELECT k, sum(ctp / cn * tp / w.all) AS ap FROM w GROUP BY 1) """


@query(_AUC + "SELECT round(avg(auc), 6) AS auc, round(avg(ap), 6) AS ap FROM a JOIN b USING (k)")
def column_scores(t):
    y = t.y().select("k", "v", (F.col("j") % 3 == 0).alias("pos"))
    return E.column_scores(y, "v", "pos", "k").select(r("auc").alias("auc"), r("ap").alias("ap"))


@query(_AUC + "SELECT k AS j, round(auc, 6) AS auc FROM a")
def pair_scores(t):
    true = t.features.select(F.lit(0).alias("i"), "feature_id", (F.col("j") % 3 == 0).alias("positive"))
    return E.pair_scores(true, t.y().select(F.col("k").alias("j"), "feature_id", "v"), "feature_id").select(F.col("j").cast("long").alias("j"), r("auc").alias("auc"))


_REC = "f AS (SELECT feature_id, (j % 7 - 3)::DOUBLE AS t, (j % 7 - 3) + ((j * 13) % 5 - 2) / 10.0::DOUBLE AS f FROM features)"


@query(ctes(CELLS, FEATURES, _REC) + """, s AS (SELECT 1 - sum(pow(t - f, 2)) / sum(pow(t - m, 2)) AS r2, corr(t, f) AS p FROM (SELECT *, avg(t) OVER () AS m FROM f))
    SELECT 'X_span' AS name, 1.0::DOUBLE AS value UNION ALL SELECT 'mu_pearson', round(p, 5) FROM s UNION ALL SELECT 'mu_r2', round(r2, 5) FROM s""")
def recovery_scores(t):
    mu, x = t.features.select("feature_id", (F.col("j") % 7 - 3).cast("double").alias("v")), t.x(1).select("k", "sample_id", "v")
    fitted = t.features.select("feature_id", ((F.col("j") % 7 - 3) + ((F.col("j") * 13) % 5 - 2) / 10.0).alias("v"))
    got = E.recovery_scores({"mu": mu, "X": x}, {"mu": fitted, "X": x}, 1)
    return t.spark.createDataFrame([(n, round(got[n], 5)) for n in ("X_span", "mu_pearson", "mu_r2")], "name string, value double")


@query("SELECT 1.0::DOUBLE AS observed, 0.0::DOUBLE AS p")
def permutation_test(t):
    a = E.long_to_array(t.y(), "feature_id", 3)
    own, _, p = E.permutation_p(t.spark, lambda x, y: E.best_match(E.squared_cosines(x, y)), a, a, n=40)
    return t.spark.createDataFrame([(round(own, 6), p)], "observed double, p double")


@query(ctes(CELLS, FEATURES, Y) + "SELECT CAST(k AS INTEGER) AS k, feature_id, round(v, 6) + 0.0::DOUBLE AS v FROM y")
def procrustes(t):
    """A turned array turns back onto the first."""
    ids = sorted(x[0] for x in t.features.select("feature_id").collect())
    a = E.long_to_array(t.y(), "feature_id", 3)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((3, 3)))[0]
    back = E.procrustes(a, q @ a)
    return t.spark.createDataFrame(pd.DataFrame([(k, f, round(float(back[k, i]), 6) + 0.0) for k in range(3) for i, f in enumerate(ids)], columns=["k", "feature_id", "v"]), "k int, feature_id string, v double")
