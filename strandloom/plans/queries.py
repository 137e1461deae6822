"""Queries over the canonical matrix view, each with its DuckDB equivalent.

Floating results are rounded, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import scalars as S
from strandloom.functions import strings as T
from strandloom.operators import aggregates as A
from strandloom.operators import batch as B
from strandloom.operators import evaluate as E
from strandloom.operators import graph as G
from strandloom.operators import joins as J
from strandloom.operators import ordered as O
from strandloom.operators import priors as P
from strandloom.operators import reshape as R
from strandloom.operators import select as L
from strandloom.operators import splits as D
from strandloom.operators.ranged import quantile
from strandloom.plans.matrix import BATCHES, CELLS, EDGES, FEATURES, MEMBERS, OBS, SAMPLES, SMALL_EDGES, X, Y, Tables, ctes
from strandloom.sources import files as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL of the same rows."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------- ingest, select


@query(ctes(OBS) + "SELECT sample_id, feature_id, view, round(value, 4) AS value FROM obs")
def obs_long(t):
    return t.obs.select("sample_id", "feature_id", "view", r("value", 4).alias("value"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", "event_type", F.from_json("props", "k INT")["k"].alias("k"))


@query("""SELECT c_nationkey, segment, count(*) AS n FROM (SELECT c_nationkey, c_mktsegment AS segment FROM customer) GROUP BY ALL""")
def wide_to_long(t):
    names = [row[0] for row in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    wide = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", names).count()
    return I.wide_to_long(wide, "c_nationkey", "segment", "n").where("n is not null").select("c_nationkey", "segment", F.col("n").cast("long").alias("n"))


@query("SELECT DISTINCT p_type AS name, p_brand AS src, p_brand AS dst, 1.0::DOUBLE AS weight FROM part")
def gene_set_self_edges(t):
    return I.self_edges(t.part.select(F.col("p_type").alias("name"), F.col("p_brand").alias("gene")).distinct())


@query(
    """WITH l AS (SELECT conv_id, turn AS line_no, CASE WHEN turn >= 3 THEN '' ELSE role END AS value FROM conversations)
    SELECT conv_id, line_no, value FROM l WHERE line_no < coalesce((SELECT min(line_no) FROM l WHERE trim(value) = ''), 1000000)"""
)
def first_block_lines(t):
    return I.first_block(t.conversations.select("conv_id", F.col("turn").alias("line_no"), F.when(F.col("turn") >= 3, "").otherwise(F.col("role")).alias("value")))


@query("SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def key_value_map(t):
    m = I.key_value_map(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("value")))
    return m.select(F.explode("map"))


@query(ctes(CELLS) + "SELECT DISTINCT feature_id, split_part(feature_id, '_', 1) AS gene, split_part(feature_id, '_', -1) AS assay FROM cells")
def feature_name_split(t):
    return t.cells.select("feature_id").distinct().select("feature_id", T.feature_gene(F.col("feature_id")).alias("gene"), T.feature_assay(F.col("feature_id")).alias("assay"))


@query(ctes(CELLS, FEATURES) + "SELECT feature_id, CAST(row_number() OVER (ORDER BY distribution, view, feature_id) - 1 AS INTEGER) AS feature_idx FROM features")
def feature_sort_index(t):
    return L.feature_index(t.features).select("feature_id", "feature_idx")


@query(ctes(OBS) + "SELECT sample_id, feature_id, round(value, 4) AS value FROM obs WHERE view IN ('A', 'R')")
def view_filter(t):
    return L.by_groups(t.obs, "view", ["A", "R"]).select("sample_id", "feature_id", r("value", 4).alias("value"))


@query(ctes(SAMPLES) + "SELECT sample_id, condition FROM samples WHERE condition NOT IN (3, 7) AND region IN (0, 1, 2)")
def group_filter(t):
    return L.by_groups(L.by_groups(t.samples, "region", [0, 1, 2]), "condition", held_out=[3, 7]).select("sample_id", "condition")


@query(ctes(OBS) + """, big AS (SELECT feature_id FROM obs WHERE value > 50000 GROUP BY 1 HAVING count(*) > 20)
    SELECT feature_id, count(*) AS n FROM obs WHERE value > 50000 AND feature_id IN (SELECT feature_id FROM big) GROUP BY 1""")
def nan_count_filter(t):
    return L.count_filter(t.obs.where("value > 50000"), 20).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))


@query(ctes(OBS, SAMPLES) + """SELECT feature_id, count(*) AS n FROM obs WHERE value > 40000 GROUP BY 1
    HAVING (SELECT count(*) FROM samples) - count(*) < 0.5 * (SELECT count(*) FROM samples)""")
def nan_fraction_filter(t):
    return L.missing_fraction_filter(t.obs.where("value > 40000"), t.samples, 0.5).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))


_VAR = """, v AS (SELECT view, feature_id, var_samp(value) AS variance FROM {src} GROUP BY ALL),
    cut AS (SELECT view, quantile_cont(variance, {q}) AS cut FROM v GROUP BY 1)
    SELECT view, feature_id, round(variance, 0) AS variance FROM v JOIN cut USING (view) WHERE variance >= cut"""


@query(ctes(OBS) + _VAR.format(src="obs", q=0.77))
def variance_filter_by_view(t):
    return L.top_variance(t.obs, 0.23).select("view", "feature_id", r("variance", 0).alias("variance"))


@query(ctes(OBS) + ", kept AS (SELECT * FROM obs WHERE feature_id IN (SELECT feature_id FROM obs WHERE value > 30000 GROUP BY 1 HAVING count(*) > 5) AND value > 30000)" + _VAR.format(src="kept", q=0.63))
def composite_filter(t):
    return L.composite_filter(t.obs.where("value > 30000"), 5, 0.37).select("view", "feature_id", r("variance", 0).alias("variance"))


@query(ctes(OBS) + """, own AS (SELECT * FROM obs WHERE view = 'N' AND feature_id IN (SELECT feature_id FROM obs WHERE view = 'N' GROUP BY 1 HAVING count(*) > 5)),
    v AS (SELECT feature_id, row_number() OVER (ORDER BY var_samp(value) DESC, feature_id) AS rn, count(*) OVER () AS k FROM own GROUP BY feature_id)
    SELECT sample_id, count(*) AS n FROM own WHERE feature_id IN (SELECT feature_id FROM v WHERE rn <= floor(0.3 * k)) GROUP BY 1 HAVING count(*) > 5""")
def sample_quality_filter(t):
    return L.sample_quality(t.obs, "N", least=5, share=0.3)


_TARGET = """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'nan' ELSE CAST(o_custkey AS VARCHAR) END AS dtd,
    CASE WHEN o_orderstatus = 'F' THEN 'nan' ELSE CAST(o_orderkey AS VARCHAR) END AS dtf,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'indeterminate' WHEN o_orderstatus = 'O' THEN 'nan' ELSE o_orderpriority END AS status FROM orders)"""


def _targets(t):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    return t.orders.select(
        k,
        F.when(s == "P", "nan").otherwise(F.col("o_custkey").cast("string")).alias("dtd"),
        F.when(s == "F", "nan").otherwise(k.cast("string")).alias("dtf"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "indeterminate").when(s == "O", "nan").otherwise(F.col("o_orderpriority")).alias("status"),
    )


@query(_TARGET + "SELECT o_orderkey, dtd <> 'nan' OR dtf <> 'nan' AS survival, status NOT IN ('nan', 'indeterminate') AS hpv, true AS ctype FROM t")
def target_filter(t):
    return _targets(t).select("o_orderkey", L.target_available("survival", "dtd", "dtf").alias("survival"), L.target_available("hpv", "status").alias("hpv"), L.target_available("ctype").alias("ctype"))


@query("SELECT l_orderkey - 100 AS i, l_linenumber - 2 AS j, l_quantity AS v FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900 AND l_linenumber BETWEEN 2 AND 4")
def coo_rectangle(t):
    return L.rectangle(t.lineitem.select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("v")), (100, 900), (2, 4))


@query("SELECT o_orderkey AS i, l_linenumber AS j, l_quantity AS v FROM orders JOIN lineitem ON l_orderkey = o_custkey")
def row_gather(t):
    coo = t.lineitem.select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("v"))
    return L.gather(coo, t.orders.select(F.col("o_orderkey").alias("new"), F.col("o_custkey").alias("old")))


@query("SELECT DISTINCT l_orderkey AS i FROM lineitem WHERE l_linenumber = 5")
def sparse_column_rows(t):
    return t.lineitem.where("l_linenumber = 5").select(F.col("l_orderkey").alias("i")).distinct()


@query(ctes(OBS, FEATURES) + "SELECT sample_id, feature_id, round(value, 4) AS value FROM obs JOIN features USING (feature_id) WHERE sample_id BETWEEN 2 AND 40 AND j BETWEEN 10 AND 30")
def block_view(t):
    d = t.obs.join(t.features.select("feature_id", F.col("j").alias("feature_idx")), "feature_id").withColumn("sample_idx", F.col("sample_id"))
    return B.block(d, (2, 40), (10, 30)).select("sample_id", "feature_id", r("value", 4).alias("value"))


@query("SELECT p_partkey, round(coalesce(p_retailprice / nullif(p_size % 7, 0), 1.0), 4) AS ratio FROM part")
def finite_guard(t):
    return t.part.select("p_partkey", r(S.guarded(S.ratio(F.col("p_retailprice"), F.col("p_size") % 7), 1.0), 4).alias("ratio"))


@query(
    """SELECT p_partkey, assay, CASE assay WHEN 'mutation' THEN 'bernoulli_sq_hinge' WHEN 'cna' THEN 'ordinal_sq_hinge3' ELSE 'normal' END AS distribution,
    CASE WHEN assay IN ('mutation', 'cna') THEN 'dna' WHEN assay = 'rppa' THEN 'protein' ELSE 'mrna' END AS dogma,
    CASE WHEN assay IN ('mutation', 'methylation') THEN -1.0 ELSE 1.0 END::DOUBLE AS weight
    FROM (SELECT p_partkey, ['mutation', 'methylation', 'mrnaseq', 'cna', 'rppa'][p_size % 5 + 1] AS assay FROM part)"""
)
def view_lookup(t):
    names = list(T.ASSAYS)
    assay = F.array(*map(F.lit, names))[F.col("p_size") % 5]
    of = lambda i: T.lookup({k: v[i] for k, v in T.ASSAYS.items()})[F.col("assay")]
    return t.part.select("p_partkey", assay.alias("assay")).select("p_partkey", "assay", of(0).alias("distribution"), of(1).alias("dogma"), of(2).alias("weight"))


@query("SELECT c_custkey, c_nationkey FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) ORDER BY n, c_nationkey, c_custkey LIMIT 40")
def smallest_groups_first(t):
    return L.smallest_groups_first(t.customer.select(F.col("c_custkey").alias("sample_id"), "c_nationkey"), "c_nationkey", 40).select(F.col("sample_id").alias("c_custkey"), "c_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t):
    return L.top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("SELECT event_type, count(*) AS n, CAST(list_position(['purchase', 'view', 'click'], event_type) AS INTEGER) AS pos FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1")
def order_by_vocabulary(t):
    n = t.events.where(F.col("event_type").isin("purchase", "view", "click")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return L.by_vocabulary(n, "event_type", ["purchase", "view", "click"])


# ---------------------------------------------------------------- joins, sets


@query(
    """WITH l AS (SELECT o_orderkey AS pos, o_custkey % 200 AS key FROM orders), rt AS (SELECT c_custkey AS pos, c_custkey % 150 AS key FROM customer)
    SELECT l.pos AS left_pos, m.right_pos FROM l JOIN (SELECT key, max(pos) AS right_pos FROM rt GROUP BY 1) m USING (key)"""
)
def keymatch_last_wins(t):
    return J.keymatch(t.orders.select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 200).alias("key")), t.customer.select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 150).alias("key")))


@query(ctes(OBS, FEATURES, SAMPLES) + """SELECT s.sample_id, f.feature_id, round(o.value, 4) AS value FROM samples s CROSS JOIN features f
    LEFT JOIN (SELECT * FROM obs WHERE value > 45000) o ON o.sample_id = s.sample_id AND o.feature_id = f.feature_id""")
def align_left(t):
    return J.align_left(t.features, t.obs.where("value > 45000"), t.samples).select("sample_id", "feature_id", r("value", 4).alias("value"))


@query("SELECT p.p_brand || '_' || p.p_type AS name, l.l_orderkey, l.l_linenumber FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")
def compound_name_join(t):
    p = t.part.select("p_partkey", T.compound(F.col("p_brand"), F.col("p_type")).alias("name"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey").select("name", "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT o_custkey AS sample_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def sample_intersection(t):
    return t.orders.select(F.col("o_custkey").alias("sample_id")).intersect(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("sample_id")))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)")
def semi_samples(t):
    return L.keep(t.supplier.select("s_suppkey", "s_acctbal"), t.lineitem.where("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")


@query(ctes(CELLS, FEATURES, MEMBERS) + "SELECT DISTINCT view, set_id, feature_id FROM members JOIN features USING (gene)")
def feature_sets_by_view(t):
    return J.feature_sets_by_view(t.members, t.features)


@query(ctes(CELLS, FEATURES, MEMBERS) + ", s AS (SELECT DISTINCT view, set_id, feature_id FROM members JOIN features USING (gene)) SELECT *, round(1 / sqrt(count(*) OVER (PARTITION BY view, set_id)), 6) AS weight FROM s")
def set_weights(t):
    return J.set_weights(J.feature_sets_by_view(t.members, t.features)).withColumn("weight", r("weight"))


@query(ctes(SMALL_EDGES) + """, n AS (SELECT DISTINCT p_brand AS node FROM part), g AS (SELECT DISTINCT pathway_id FROM small_edges),
    used AS (SELECT pathway_id, src AS node FROM small_edges UNION SELECT pathway_id, dst FROM small_edges)
    SELECT pathway_id, node FROM g CROSS JOIN n WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.pathway_id = g.pathway_id AND u.node = n.node)""")
def anti_nongraph(t):
    return J.outside_graphs(t.part.select(F.col("p_brand").alias("node")).distinct(), t.small_edges, t.small_edges.select("pathway_id").distinct())


def _batch_query(how):
    return lambda t: J.batch_apply(t.obs, t.batch_map, t.batch_values, how).select("sample_id", "feature_id", r("result", 3).alias("result"))


for _how, _op, _zero in (("add", "+", 0), ("subtract", "-", 0), ("multiply", "*", 1), ("divide", "/", 1)):
    _f = _batch_query(_how)
    _f.__name__ = f"batch_{_how}"
    query(ctes(OBS, FEATURES, BATCHES) + f"""SELECT sample_id, feature_id, round(value {_op} coalesce(batch_value, {_zero}), 3) AS result
    FROM obs LEFT JOIN batch_map USING (view, sample_id) LEFT JOIN batch_values USING (view, batch, feature_id)""")(_f)


@query("""WITH g AS (SELECT n_nationkey AS "group" FROM nation), w AS (SELECT c_nationkey AS "group", avg(c_acctbal) AS weight FROM customer WHERE c_nationkey < 12 GROUP BY 1)
    SELECT "group", round(coalesce(weight, (SELECT avg(weight) FROM w)), 4) AS weight FROM g LEFT JOIN w USING ("group")""")
def group_weight_fill(t):
    w = t.customer.where("c_nationkey < 12").groupBy(F.col("c_nationkey").alias("group")).agg(F.avg("c_acctbal").alias("weight"))
    return J.fill_group_weights(t.nation.select(F.col("n_nationkey").alias("group")), w).withColumn("weight", r("weight", 4))


@query(ctes(CELLS) + "SELECT gene, array_to_string(list_sort(list(DISTINCT feature_id)), ',') AS features FROM cells GROUP BY 1")
def gene_feature_map(t):
    return J.multimap(t.cells, "gene", "feature_id").select("gene", F.array_join("values", ",").alias("features"))


_BARCODE = "(SELECT o_orderkey, 'TS-' || o_custkey || '-' || (o_orderkey % 13) || '-' || (o_custkey % 5) AS a, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'X-' || (o_orderkey % 7) || '-9' END AS b FROM orders)"


@query(f"SELECT o_orderkey, view, CASE WHEN barcode = '' THEN '' ELSE array_to_string(string_split(barcode, '-')[-2:], '-') END AS batch FROM {_BARCODE} UNPIVOT (barcode FOR view IN (a, b))")
def barcode_batches(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    wide = t.orders.select(k, F.concat_ws("-", F.lit("TS"), s(c), s(k % 13), s(c % 5)).alias("a"), F.when(k % 3 == 0, "").otherwise(F.concat_ws("-", F.lit("X"), s(k % 7), F.lit("9"))).alias("b"))
    return wide.unpivot("o_orderkey", ["a", "b"], "view", "barcode").select("o_orderkey", "view", T.barcode_batch(F.col("barcode")).alias("batch"))


@query(ctes(CELLS, FEATURES, SAMPLES, X, Y) + "SELECT sample_id AS i, feature_id AS j, round(sum(x.v * y.v), 6) AS v FROM x JOIN y USING (k) GROUP BY ALL")
def matrix_product(t):
    p = J.matrix_product(t.x().select(F.col("sample_id").alias("i"), "k", "v"), t.y().select("k", F.col("feature_id").alias("j"), "v"))
    return p.select("i", "j", r("v").alias("v"))


@query("SELECT a.r_name AS region, b.event_type, p.f AS f, p.s AS s FROM region a, (SELECT DISTINCT event_type FROM events) b, (VALUES (1, 'x'), (2, 'y')) p(f, s)")
def param_grid(t):
    z = t.spark.createDataFrame([([1, 2], ["x", "y"])], "f array<int>, s array<string>").select(F.inline(F.arrays_zip("f", "s")))
    return J.parameter_grid([t.region.select(F.col("r_name").alias("region")), t.events.select("event_type").distinct(), z])


_PAIR = "WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity < 5), b AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 48) "


def _pair(t):
    return tuple(t.lineitem.where(c).select(F.col("l_partkey").alias("p")).distinct() for c in ("l_quantity < 5", "l_quantity > 48"))


@query(_PAIR + "SELECT p FROM a UNION SELECT p FROM b")
def set_union(t):
    a, b = _pair(t)
    return a.unionByName(b).distinct()


@query(_PAIR + "SELECT p FROM a INTERSECT SELECT p FROM b")
def set_intersect(t):
    a, b = _pair(t)
    return a.intersect(b)


@query(_PAIR + "SELECT p FROM a EXCEPT SELECT p FROM b")
def set_difference(t):
    a, b = _pair(t)
    return a.subtract(b)


@query(_PAIR + "SELECT p FROM a UNION ALL SELECT p FROM b")
def bag_union(t):
    a, b = _pair(t)
    return a.unionByName(b)


@query(_PAIR + "SELECT NOT EXISTS (SELECT p FROM a EXCEPT SELECT p FROM b) AS subset")
def subset_check(t):
    a, b = _pair(t)
    return a.join(b, "p", "left_anti").agg((F.count(F.lit(1)) == 0).alias("subset"))


# ---------------------------------------------------------------- aggregates


@query(ctes(OBS) + """SELECT feature_id, count(value) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, round(sqrt(avg(value * value)), 4) AS rms,
    round(stddev_samp(value), 3) AS sd, round(stddev_pop(value), 3) AS sd_pop FROM obs GROUP BY 1""")
def column_stats(t):
    s = A.column_stats(t.obs, "feature_id")
    return s.select("feature_id", "n", r("total", 2).alias("total"), r("mean", 4).alias("mean"), r("rms", 4).alias("rms"), r(F.sqrt("var_samp"), 3).alias("sd"), r(F.sqrt("var_pop"), 3).alias("sd_pop"))


@query(ctes(OBS) + "SELECT feature_id, round(greatest(var_samp(value / 100000), 1.0 / 25), 8) AS variance FROM obs GROUP BY 1")
def floored_variance(t):
    return A.floored_variance(t.obs.withColumn("value", F.col("value") / 100000), 25).select("feature_id", r("variance", 8).alias("variance"))


@query(ctes(OBS, FEATURES, BATCHES) + "SELECT view, batch, feature_id, round(sum(ln(value)), 5) AS total FROM obs JOIN batch_map USING (view, sample_id) GROUP BY ALL")
def batch_column_sums(t):
    return A.batch_sums(t.obs, t.batch_map, F.ln).withColumn("total", r("total", 5))


@query(ctes(CELLS, FEATURES, BATCHES) + "SELECT view, batch, round(avg(batch_value), 6) AS mean, round(var_samp(batch_value), 6) AS variance FROM batch_values GROUP BY ALL")
def theta_moments(t):
    return A.theta_moments(t.batch_values).select("view", "batch", r("mean").alias("mean"), r("variance").alias("variance"))


@query(ctes(CELLS, FEATURES, BATCHES) + """, m AS (SELECT view, batch, avg(batch_value) AS m, var_samp(batch_value) AS v FROM batch_values GROUP BY ALL)
    SELECT view, batch, round(2 + m * m / (v + 1e-9), 5) AS alpha, round(m * (1 + m * m / (v + 1e-9)), 5) AS beta FROM m""")
def delta2_moments(t):
    return A.inverse_gamma_moments(t.batch_values).select("view", "batch", r("alpha", 5).alias("alpha"), r("beta", 5).alias("beta"))


@query("""SELECT event_type, round(avg(value * ln(value)) - avg(value) * avg(ln(value)), 6) AS beta,
    round(avg(value) / (avg(value * ln(value)) - avg(value) * avg(ln(value)) + 1e-12), 6) AS alpha FROM events WHERE value > 0 GROUP BY 1""")
def gamma_moments(t):
    return A.gamma_moments(t.events.where("value > 0"), "value", "event_type").select("event_type", r("beta").alias("beta"), r("alpha").alias("alpha"))


@query("""SELECT op, event_type, d, round(v, 4) AS v FROM (
    SELECT 'mean' AS op, event_type, CAST(ts AS DATE) AS d, avg(value / 1.37) AS v FROM events GROUP BY ALL UNION ALL
    SELECT 'std', event_type, CAST(ts AS DATE), stddev_samp(value / 1.37) FROM events GROUP BY ALL UNION ALL
    SELECT 'median', event_type, CAST(ts AS DATE), median(value / 1.37) FROM events GROUP BY ALL UNION ALL
    SELECT 'count', event_type, CAST(ts AS DATE), CAST(count(value) AS DOUBLE) FROM events GROUP BY ALL)""")
def replicate_agg(t):
    e = t.events.select("event_type", F.to_date("ts").alias("d"), "user_id", (F.col("value") / 1.37).alias("value"))
    out = None
    for op in ("mean", "std", "median", "count"):
        one = A.replicate_aggregate(e, ["user_id"], "value", op).select(F.lit(op).alias("op"), "event_type", "d", r(F.col("value").cast("double"), 4).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_mktsegment, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def value_counts(t):
    return A.value_counts(t.customer, "c_mktsegment").withColumn("share", r("share"))


@query("""SELECT round(avg(CASE WHEN quality = (SELECT quality FROM labels WHERE toxic = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM labels""")
def mode_baseline(t):
    return A.mode_accuracy(t.labels.where("toxic = 0"), t.labels, "quality").select(r("accuracy").alias("accuracy"))


@query("SELECT round(avg(pow(value - (SELECT avg(value) FROM events WHERE event_type = 'click'), 2)), 4) AS mse FROM events")
def mean_baseline(t):
    return A.mean_baseline_mse(t.events.where("event_type = 'click'"), t.events, "value").select(r("mse", 4).alias("mse"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(t):
    return A.confusion(t.labels, "quality", "toxic")


@query("SELECT user_id, min(event_id) AS first_pos FROM events GROUP BY 1")
def first_seen(t):
    return A.first_seen(t.events, "user_id", "event_id")


@query(ctes(OBS, FEATURES, SAMPLES) + """, o AS (SELECT * FROM obs WHERE value > 40000), m AS (SELECT feature_id, median(value) AS median FROM o GROUP BY 1)
    SELECT s.sample_id, f.feature_id, round(coalesce(o.value, m.median), 4) AS value FROM samples s CROSS JOIN features f
    LEFT JOIN o ON o.sample_id = s.sample_id AND o.feature_id = f.feature_id LEFT JOIN m ON m.feature_id = f.feature_id""")
def median_impute(t):
    o = t.obs.where("value > 40000")
    return A.median_impute(J.align_left(t.features, o, t.samples), A.medians(o)).withColumn("value", r("value", 4))


@query(ctes(OBS) + """SELECT sample_id, feature_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 5) AS value FROM obs WINDOW w AS (PARTITION BY feature_id)""")
def standardize(t):
    return A.standardise(t.obs).select("sample_id", "feature_id", r("value", 5).alias("value"))


@query(ctes(CELLS, FEATURES, Y) + "SELECT k, view, round(sum(v * v), 6) AS ssq FROM y GROUP BY GROUPING SETS ((k), (k, view))")
def scree_total_and_view(t):
    return A.factor_norms(t.y()).select(F.col("k").cast("long").alias("k"), "view", r("ssq").alias("ssq"))


@query(ctes(OBS) + """, e AS (SELECT feature_id, (value - avg(value) OVER (PARTITION BY feature_id)) / 1000 AS e FROM obs)
    SELECT feature_id, round(CASE WHEN sum(e * e) > 0 THEN ln(sqrt(sum(e * e) / count(e))) END, 5) AS logsigma FROM e GROUP BY 1""")
def column_scale_init(t):
    e = t.obs.withColumn("e", (F.col("value") - F.avg("value").over(Window.partitionBy("feature_id"))) / 1000)
    return A.scale_from_errors(e).withColumn("logsigma", r("logsigma", 5))


@query(ctes(OBS) + """, g AS (SELECT feature_id, (value - 50000) / 10000 AS g, 2.0 AS sigma FROM obs)
    SELECT feature_id, round(1 / nullif(sqrt(sum(g * g) / 500) * 2.0, 0), 6) AS weight FROM g GROUP BY 1""")
def loss_weights(t):
    return A.loss_weights(t.obs.select("feature_id", ((F.col("value") - 50000) / 10000).alias("g"), F.lit(2.0).alias("sigma")), 500).withColumn("weight", r("weight"))


@query("""WITH d AS (SELECT p_type, p_size % 3 + 1 AS level FROM part), g AS (SELECT p_type, level FROM (SELECT DISTINCT p_type FROM part), (VALUES (1), (2), (3)) v(level)),
    n AS (SELECT g.p_type, g.level, count(d.level) + 1 AS n FROM g LEFT JOIN d ON d.p_type = g.p_type AND d.level = g.level GROUP BY ALL),
    p AS (SELECT p_type, level, sum(n) OVER (PARTITION BY p_type ORDER BY level) / sum(n) OVER (PARTITION BY p_type) AS p FROM n)
    SELECT p_type, level, round(ln(p / (1 - p)), 6) AS threshold FROM p WHERE level < 3""")
def ordinal_thresholds(t):
    return A.ordinal_thresholds(t.part.select("p_type", (F.col("p_size") % 3 + 1).alias("level")), "p_type", "level", [1, 2, 3]).withColumn("threshold", r("threshold"))


_DISC = """, o AS (SELECT o.sample_id, o.feature_id, o.view, f.distribution, CASE f.distribution WHEN 'bernoulli' THEN CASE WHEN value > 50000 THEN 1.0 ELSE 0.0 END
    WHEN 'poisson' THEN floor(value / 20000) ELSE value / 10000 END AS d FROM obs o JOIN features f USING (feature_id))"""


def _typed(t):
    """obs made to fit the noise model of its view, as d."""
    v = F.col("value")
    d = S.case(F.col("distribution"), {"bernoulli": F.when(v > 50000, 1.0).otherwise(0.0), "poisson": F.floor(v / 20000).cast("double")}, v / 10000)
    return t.obs.join(t.features.select("feature_id", "distribution"), "feature_id").withColumn("d", d)


@query(ctes(OBS, FEATURES) + _DISC + """, m AS (SELECT feature_id, distribution, avg(d) AS m FROM o GROUP BY ALL)
    SELECT feature_id, round(CASE WHEN distribution = 'bernoulli' THEN CASE WHEN m > 0 AND m < 1 THEN ln(m / (1 - m)) END WHEN distribution = 'poisson' THEN CASE WHEN m > 0 THEN ln(m) END ELSE m END, 5) AS mu FROM m""")
def m_estimates(t):
    return A.m_estimates(_typed(t).withColumn("value", F.col("d"))).withColumn("mu", r("mu", 5))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS score FROM lineitem GROUP BY 1")
def weighted_scores(t):
    return A.weighted_mean(t.lineitem.select("l_returnflag", F.col("l_discount").alias("score"), F.col("l_quantity").alias("size")), "l_returnflag").withColumn("score", r("score"))


_TF = "(SELECT l_returnflag, l_quantity AS t, l_extendedprice / 1500 AS f FROM lineitem)"


@query(f"""WITH d AS (SELECT *, avg(t) OVER (PARTITION BY l_returnflag) AS mt, rank() OVER (PARTITION BY l_returnflag ORDER BY t) + (count(*) OVER (PARTITION BY l_returnflag, t) - 1) / 2.0 AS rt,
    rank() OVER (PARTITION BY l_returnflag ORDER BY f) + (count(*) OVER (PARTITION BY l_returnflag, f) - 1) / 2.0 AS rf FROM {_TF})
    SELECT l_returnflag, round(1 - sum(pow(t - f, 2)) / sum(pow(t - mt, 2)), 6) AS r2, round(corr(t, f), 6) AS pearson, round(corr(rt, rf), 6) AS spearman FROM d GROUP BY 1""")
def r2_pearson_spearman(t):
    d = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("t"), (F.col("l_extendedprice") / 1500).alias("f"))
    return A.recovery(d, "l_returnflag").select("l_returnflag", r("r2").alias("r2"), r("pearson").alias("pearson"), r("spearman").alias("spearman"))


@query("SELECT o_orderpriority, round(avg(100 * (o_totalprice - 150000) / 150000), 4) AS gain FROM orders GROUP BY 1")
def relative_gain(t):
    return A.relative_gain(t.orders.select("o_orderpriority", F.col("o_totalprice").alias("score"), F.lit(150000.0).alias("baseline")), "o_orderpriority").withColumn("gain", r("gain", 4))


@query(ctes(CELLS, FEATURES, Y) + "SELECT view, k, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM y GROUP BY ALL")
def positive_rate(t):
    return A.positive_rate(t.y(), "v", "view", "k").select("view", F.col("k").cast("long").alias("k"), r("rate").alias("rate"))


# ---------------------------------------------------------------- order


@query("SELECT l_orderkey, l_suppkey % 3 AS g, min(l_linenumber) AS start, max(l_linenumber) AS stop, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS contiguous FROM lineitem GROUP BY ALL")
def islands_ranges(t):
    return O.ranges(t.lineitem.withColumn("g", F.col("l_suppkey") % 3), "g", "l_linenumber", "l_orderkey")


@query("""WITH c AS (SELECT user_id, event_type, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS new FROM events)
    SELECT user_id, sum(CAST(new AS INTEGER)) = count(DISTINCT event_type) AS contiguous FROM c GROUP BY 1""")
def contiguity(t):
    return O.is_contiguous(t.events, "event_type", "event_id", "user_id")


@query("SELECT o_orderkey AS idx, greatest(o_custkey, 300) AS start, least(o_custkey + 40, 500) AS stop FROM orders WHERE o_custkey + 40 >= 300 AND o_custkey <= 500")
def range_clip(t):
    return O.clip_ranges(t.orders.select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + 40).alias("stop")), 300, 500)


@query("""WITH g AS (SELECT p_type, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1)
    SELECT *, (first + last) / 2 AS mid, CAST((row_number() OVER (ORDER BY first) - 1) % 2 AS INTEGER) AS odd FROM g""")
def block_layout(t):
    return O.block_layout(t.part, "p_type", "p_partkey")


_SCORED = "s AS (SELECT toxic, quality = 1 AS truth, CAST(doc_id % 37 AS DOUBLE) AS score FROM labels)"
_CURVE = f"""WITH {_SCORED}, g AS (SELECT toxic, score, sum(CAST(truth AS INTEGER)) AS p, count(*) AS n FROM s GROUP BY ALL),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS upto, sum(p) OVER (PARTITION BY toxic) AS pos, sum(n) OVER (PARTITION BY toxic) AS total FROM g
        WINDOW w AS (PARTITION BY toxic ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) """


def _scored(t):
    return t.labels.select("toxic", (F.col("quality") == 1).alias("truth"), (F.col("doc_id") % 37).cast("double").alias("score"))


@query(_CURVE + "SELECT toxic, round(sum(tp / upto * p / nullif(pos, 0)), 6) AS ap FROM c GROUP BY 1")
def average_precision(t):
    return O.average_precision(_scored(t), "score", "truth", "toxic").withColumn("ap", r("ap"))


@query(_CURVE + "SELECT toxic, score, round(tp / upto, 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall FROM c")
def pr_curve(t):
    return O.pr_curve(_scored(t), "score", "truth", "toxic").select("toxic", "score", r("precision").alias("precision"), r("recall").alias("recall"))


@query(_CURVE + "SELECT toxic, score, round((upto - tp) / nullif(total - pos, 0), 6) AS fpr, round(tp / nullif(pos, 0), 6) AS tpr FROM c")
def roc_curve(t):
    return O.roc_curve(_scored(t), "score", "truth", "toxic").select("toxic", "score", r("fpr").alias("fpr"), r("tpr").alias("tpr"))


@query(f"""WITH {_SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY toxic ORDER BY score) + (count(*) OVER (PARTITION BY toxic, score) - 1) / 2.0 AS rk FROM s),
    a AS (SELECT toxic, sum(rk) FILTER (truth) AS rs, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM k GROUP BY 1)
    SELECT toxic, round(coalesce((rs - p * (p + 1) / 2.0) / nullif(p * n, 0), 0.5), 6) AS auc FROM a""")
def roc_auc(t):
    return O.roc_auc(_scored(t), "score", "truth", "toxic").withColumn("auc", r("auc"))


@query("""WITH p AS (SELECT event_type, CAST(date_part('hour', ts) AS DOUBLE) AS x, avg(value) AS y FROM events GROUP BY ALL),
    s AS (SELECT event_type, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS s FROM p WINDOW w AS (PARTITION BY event_type ORDER BY x, y))
    SELECT event_type, round(coalesce(sum(s), 0), 4) AS area FROM s GROUP BY 1""")
def trapezoid_area(t):
    p = t.events.groupBy("event_type", F.hour("ts").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return O.trapezoid(p, "x", "y", "event_type").withColumn("area", r("area", 4))


@query(ctes(OBS) + """, v AS (SELECT view, gene, CAST(replace(gene, 'Brand#', '') AS INTEGER) AS k, round(avg(value), 2) AS m FROM obs GROUP BY ALL),
    b AS (SELECT view, row_number() OVER w AS n, lead(m) OVER w - 2 * m + lag(m) OVER w AS bend FROM v WINDOW w AS (PARTITION BY view ORDER BY k)),
    q AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY bend DESC, n) AS rn FROM b WHERE bend IS NOT NULL)
    SELECT view, CAST(greatest(n, 3) AS INTEGER) AS components FROM q WHERE rn = 1""")
def elbow(t):
    v = t.obs.groupBy("view", "gene").agg(F.round(F.avg("value"), 2).alias("m")).withColumn("k", F.regexp_replace("gene", "Brand#", "").cast("int"))
    return O.elbow(v, "k", "m", "view", least=3)


@query("""WITH b AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
    SELECT p_type, n, CAST(coalesce(sum(n) OVER (ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b""")
def block_offsets(t):
    return O.block_offsets(t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "p_type", "n")


@query("SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type FROM part)")
def label_encode(t):
    return O.label_codes(t.part, "p_type")


@query("""WITH s AS (SELECT p_size % 4 AS k, p_type AS view, p_brand AS set_name, sum(CAST(p_partkey % 11 AS BIGINT)) - 20 AS score FROM part GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY view, score DESC, set_name) AS pos, row_number() OVER (PARTITION BY k, view ORDER BY score DESC, set_name) AS iv FROM s WHERE score > 0)
    SELECT k, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = 1 THEN 'Factor ' || k ELSE '' END AS factor, CASE WHEN iv = 1 THEN view ELSE '' END AS view, set_name, CAST(score AS BIGINT) AS score FROM o""")
def interpret_report(t):
    s = t.part.groupBy((F.col("p_size") % 4).alias("k"), F.col("p_type").alias("view"), F.col("p_brand").alias("set_name")).agg((F.sum(F.col("p_partkey") % 11) - 20).alias("score"))
    return O.interpret_report(s)


@query(ctes(CELLS, FEATURES, Y) + "SELECT k, CAST(row_number() OVER (ORDER BY round(sum(v * v), 6) DESC, k) - 1 AS INTEGER) AS new_k FROM y GROUP BY k")
def factor_reorder(t):
    return O.factor_order(t.y()).select(F.col("k").cast("long").alias("k"), "new_k")


@query(ctes(EDGES) + "SELECT pathway_id, least(src, dst) AS lo, greatest(src, dst) AS hi, arg_max(weight, pos) AS weight FROM edges GROUP BY ALL")
def edge_dedup_latest(t):
    return G.undirected(t.edges, "pathway_id")


@query("""WITH h AS (SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'fit_start' WHEN event_type IN ('click', 'view', 'purchase') THEN 'fit_step' ELSE event_type END AS name FROM events),
    m AS (SELECT *, sum(CASE WHEN name = 'fit_start' OR name NOT LIKE 'fit%' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS run, sum(CASE WHEN name = 'fit_start' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS fit FROM h),
    f AS (SELECT *, first_value(name) OVER (PARTITION BY run ORDER BY event_id) AS opener FROM m)
    SELECT event_id, name, CAST(fit AS BIGINT) AS fit FROM f WHERE opener = 'fit_start'""")
def history_segments(t):
    e, c = F.col("event_type"), F.col("event_id")
    name = F.when((e == "click") & (c % 4 == 0), "fit_start").when(e.isin("click", "view", "purchase"), "fit_step").otherwise(e)
    return O.history_segments(t.events.select("event_id", name.alias("name")), "event_id", "name", "fit_start", "fit")


# ---------------------------------------------------------------- scalars, strings, shapes


@query("SELECT event_id, round(ln((0.5 + (x - 0.5) * 0.99) / (1 - (0.5 + (x - 0.5) * 0.99))), 6) AS z FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS x FROM events)")
def logit_shrunk(t):
    return t.events.select("event_id", r(S.shrunken_logit((F.col("event_id") % 101) / 100.0)).alias("z"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 1.0 WHEN s_acctbal > 5000 THEN 3.0 ELSE 2.0 END::DOUBLE AS level FROM supplier")
def threshold3(t):
    return t.supplier.select("s_suppkey", S.three_level(F.col("s_acctbal"), 0.0, 5000.0).alias("level"))


@query("""WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.333) AS lo, quantile_cont(c_acctbal, 0.667) AS hi FROM customer GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_acctbal <= lo THEN 1.0 WHEN c_acctbal > hi THEN 3.0 ELSE 2.0 END::DOUBLE AS level FROM customer JOIN q USING (c_mktsegment)""")
def threshold3_quantile(t):
    q = quantile(t.customer, "c_acctbal", 0.333, "c_mktsegment", name="lo").join(quantile(t.customer, "c_acctbal", 0.667, "c_mktsegment", name="hi"), "c_mktsegment")
    return t.customer.join(q, "c_mktsegment").select("c_custkey", S.three_level(F.col("c_acctbal"), F.col("lo"), F.col("hi")).alias("level"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1.0 ELSE l_quantity END::DOUBLE AS v FROM lineitem")
def binarize(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.binarise(F.col("l_quantity"), 25).alias("v"))


@query("""SELECT p_partkey, assay, round(CASE assay WHEN 'methylation' THEN ln((0.5 + (x - 0.5) * 0.99) / (1 - (0.5 + (x - 0.5) * 0.99))) WHEN 'cna' THEN CASE WHEN x <= -0.5 THEN 1.0 WHEN x > 0.5 THEN 3.0 ELSE 2.0 END
    WHEN 'mutation' THEN CASE WHEN x > 0 THEN 1.0 ELSE x END ELSE x END, 6) AS v
    FROM (SELECT p_partkey, ['mutation', 'methylation', 'mrnaseq', 'cna'][p_partkey % 4 + 1] AS assay, (p_size % 21) / 20.0::DOUBLE AS x FROM part)""")
def assay_transform(t):
    assay = F.array(*map(F.lit, ("mutation", "methylation", "mrnaseq", "cna")))[(F.col("p_partkey") % 4).cast("int")]
    d = t.part.select("p_partkey", assay.alias("assay"), ((F.col("p_size") % 21) / 20.0).alias("x"))
    return d.select("p_partkey", "assay", r(S.assay_transform(F.col("assay"), F.col("x"))).alias("v"))


@query("SELECT s_suppkey, round(greatest(abs(s_acctbal) - 1500.5, 0), 2) AS v FROM supplier")
def soft_threshold(t):
    return t.supplier.select("s_suppkey", r(S.soft_threshold(F.col("s_acctbal"), 1500.5), 2).alias("v"))


@query("SELECT event_id, round((1.0 + 0.5) * (ln(0.5 + 0.5 * value * value) - ln(0.5)), 6) AS penalty FROM events")
def ard_penalty(t):
    return t.events.select("event_id", r(S.ard_curve(F.col("value"), 1.0, 0.5)).alias("penalty"))


@query("SELECT p_partkey, round(CASE WHEN m IN (0, 1) THEN 0.0 ELSE least(pow(0.2 / (m * (1 - m)), 2), 9.0) END, 6) AS v FROM (SELECT p_partkey, (p_size % 11) / 10.0::DOUBLE AS m FROM part)")
def bernoulli_variance(t):
    return t.part.select("p_partkey", r(S.bernoulli_variance((F.col("p_size") % 11) / 10.0, F.lit(0.2))).alias("v"))


@query("SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END WHEN 1 THEN CASE WHEN z <= -1 THEN 1.0 WHEN z <= 1 THEN 2.0 ELSE 3.0 END ELSE z END, 6) AS d FROM (SELECT c_custkey, c_acctbal / 2000 - 2 AS z FROM customer)")
def discretise(t):
    kind = F.when(F.col("c_custkey") % 3 == 0, "bernoulli").when(F.col("c_custkey") % 3 == 1, "ordinal3").otherwise("normal")
    return t.customer.select("c_custkey", r(S.discretise(kind, F.col("c_acctbal") / 2000 - 2)).alias("d"))


_Z = ", z AS (SELECT sample_id, feature_id, sum(x.v * y.v) AS z FROM x JOIN y USING (k) GROUP BY ALL)"


def _latent(t):
    z = J.matrix_product(t.x().select(F.col("sample_id").alias("i"), "k", "v"), t.y().select("k", F.col("feature_id").alias("j"), "v"))
    return z.select(F.col("i").alias("sample_id"), F.col("j").alias("feature_id"), F.col("v").alias("z"))


@query(ctes(CELLS, FEATURES, SAMPLES, X, Y) + _Z + "SELECT sample_id, feature_id, round(CASE distribution WHEN 'bernoulli' THEN 1 / (1 + exp(-z)) WHEN 'poisson' THEN exp(z) ELSE z END, 6) AS value FROM z JOIN features USING (feature_id)")
def impute_by_distribution(t):
    return _latent(t).join(t.features.select("feature_id", "distribution"), "feature_id").select("sample_id", "feature_id", r(S.impute(F.col("distribution"), F.col("z"))).alias("value"))


_SURV = "s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS DOUBLE) END AS dtd, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey % 977 AS DOUBLE) END AS dtf FROM orders)"


def _survival(t):
    s = F.col("o_orderstatus") == "F"
    return t.orders.select("o_orderkey", F.when(s, F.col("o_custkey").cast("double")).alias("dtd"), F.when(~s, (F.col("o_orderkey") % 977).cast("double")).alias("dtf"))


@query(f"WITH {_SURV} SELECT o_orderkey, dtd IS NOT NULL AS dead, coalesce(dtd, dtf) AS time FROM s")
def survival_event(t):
    return _survival(t).select("o_orderkey", S.survival_dead(F.col("dtd")).alias("dead"), S.survival_time(F.col("dtd"), F.col("dtf")).alias("time"))


@query(f"WITH {_SURV}, m AS (SELECT median(dtd) AS md, median(dtf) AS mf FROM s) SELECT o_orderkey, CASE WHEN dtd IS NOT NULL THEN CASE WHEN dtd > md THEN 1 ELSE 0 END ELSE CASE WHEN dtf > mf THEN 3 ELSE 2 END END AS stratum FROM s, m")
def survival_strata(t):
    s = _survival(t)
    m = quantile(s, "dtd", 0.5, name="md").crossJoin(quantile(s, "dtf", 0.5, name="mf"))
    return s.crossJoin(F.broadcast(m)).select("o_orderkey", S.survival_stratum(F.col("dtd"), F.col("dtf"), F.col("md"), F.col("mf")).alias("stratum"))


@query("""SELECT p_partkey, [0, 1, 2, 3, 0, 2][CAST(p_partkey % 6 AS INTEGER) + 1] AS code FROM part""")
def stage_encoding(t):
    names = F.array(*map(F.lit, ("Stage I", "stage ii", "Stage IIIB", "stage iv", "stage ia", "Stage IIIc")))
    return t.part.select("p_partkey", S.stage_code(names[(F.col("p_partkey") % 6).cast("int")]).alias("code"))


_SIF = "(SELECT p_partkey, p_brand AS src, ['a>', 'a|', 'd>', 't>', 't|', 'p>'][p_size % 6 + 1] AS itype, p_type AS dst FROM part)"


@query(f"""SELECT p_partkey, src || '_activation' AS u, dst || '_' || CASE itype[1] WHEN 'a' THEN 'activation' WHEN 'd' THEN 'dna' WHEN 't' THEN 'mrna' ELSE 'protein' END AS v,
    CASE itype[2] WHEN '>' THEN 1.0 ELSE -1.0 END::DOUBLE AS w FROM {_SIF}""")
def sif_decode(t):
    kind = F.array(*map(F.lit, ("a>", "a|", "d>", "t>", "t|", "p>")))[F.col("p_size") % 6]
    e = t.part.select("p_partkey", F.col("p_brand").alias("src"), kind.alias("itype"), F.col("p_type").alias("dst"))
    return e.select("p_partkey", T.edge_source(F.col("src")).alias("u"), T.edge_target(F.col("dst"), F.col("itype")).alias("v"), T.edge_weight(F.col("itype")).alias("w"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 't>' ELSE 'a>' END AS itype, split_part(o_orderpriority, '_', 1) || '_x' AS target FROM orders")
def interaction_translate(t):
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", T.interaction_code(F.when(p == "1-URGENT", "controls-expression-of").otherwise(p)).alias("itype"), T.data_edge_target(F.concat(F.split(p, "_")[0], F.lit("_x_3"))).alias("target"))


@query("""SELECT page_id, k, v FROM (SELECT page_id, 'lang' AS k, 'l' || (page_id % 3) AS v FROM pages UNION ALL SELECT page_id, 'id', CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT page_id, 'id_+', 'b' FROM pages)""")
def path_kvs(t):
    p = F.concat(F.lit("root/lang=l"), (F.col("page_id") % 3).cast("string"), F.lit("__id="), F.col("page_id").cast("string"), F.lit("/id=b.json"))
    return t.pages.select("page_id", F.inline(T.path_pairs(p)))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f_%.2f', l_discount, l_tax) AS label FROM lineitem")
def corruption_label(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", T.corruption_label(F.col("l_discount"), F.col("l_tax")).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '_' || p_partkey ELSE p_brand END AS label FROM part")
def feature_label(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", T.view_label(name, F.col("p_type")).alias("label"))


@query("SELECT DISTINCT n AS name, p_brand AS src FROM (SELECT p_brand, unnest(string_split(p_type || ';' || p_brand || ';' || p_type, ';')) AS n FROM part WHERE p_size > 10)")
def explode_multimap(t):
    names = F.when(F.col("p_size") > 10, F.concat_ws(";", "p_type", "p_brand", "p_type"))
    return I.explode_names(t.part.select(F.col("p_brand").alias("src"), names.alias("names")))


@query("""SELECT l_shipyear, round(max(v) FILTER (l_returnflag = 'A'), 4) AS A, round(max(v) FILTER (l_returnflag = 'N'), 4) AS N, round(max(v) FILTER (l_returnflag = 'R'), 4) AS R
    FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipyear, l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY 1""")
def pivot_grid(t):
    g = t.lineitem.groupBy(F.year("l_shipdate").alias("l_shipyear"), "l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("v"))
    return R.pivot_grid(g, "l_shipyear", "l_returnflag", "v", ["A", "N", "R"])


@query("SELECT c_custkey, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS is_MACHINERY, CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS is_HOUSEHOLD FROM customer")
def indicator_matrix(t):
    return R.indicator(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "HOUSEHOLD"]).drop("c_mktsegment")


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS items FROM nation GROUP BY 1")
def grouped_lists(t):
    return R.grouped_lists(t.nation, ["n_regionkey"], "n_name").withColumn("items", F.array_join("items", ","))


@query("SELECT event_id, CAST(event_id % 5 AS VARCHAR) AS run, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) ELSE 'path' END AS k FROM events")
def json_merge(t):
    own = F.when(F.col("event_id") % 2 == 0, F.from_json("props", "map<string,string>")).otherwise(F.create_map().cast("map<string,string>"))
    rec = t.events.select("event_id", F.concat(F.lit("run="), (F.col("event_id") % 5).cast("string"), F.lit("__k=path.json")).alias("path"), own.alias("content"))
    m = rec.withColumn("m", R.merge_records(F.col("path"), F.col("content")))
    return m.select("event_id", F.col("m")["run"].alias("run"), F.col("m")["k"].alias("k"))


# ---------------------------------------------------------------- graphs


@query(ctes(EDGES) + "SELECT DISTINCT pathway_id, split_part(n, '_', 1) AS entity FROM (SELECT pathway_id, src AS n FROM edges UNION ALL SELECT pathway_id, dst FROM edges)")
def node_set(t):
    return G.entities(t.edges, "pathway_id")


@query(ctes(EDGES) + """, u AS (SELECT DISTINCT pathway_id, least(src, dst) AS lo, greatest(src, dst) AS hi FROM edges)
    SELECT pathway_id, node, count(*) AS degree FROM (SELECT pathway_id, lo AS node FROM u UNION ALL SELECT pathway_id, hi FROM u) GROUP BY ALL""")
def node_degrees(t):
    return G.node_degrees(t.edges, "pathway_id")


@query(ctes(EDGES) + "SELECT DISTINCT pathway_id, least(src, dst) AS lo, greatest(src, dst) AS hi, CAST(sign(weight) AS INTEGER) AS sign FROM edges")
def signed_edges(t):
    return G.signed_edges(t.edges, "pathway_id")


_CHAIN = "(VALUES ('dna', 'mrna'), ('mrna', 'protein'), ('protein', 'activation')) c(a, b)"


@query(f"SELECT gene || '_' || a AS src, gene || '_' || b AS dst, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT p_brand AS gene FROM part), {_CHAIN}")
def dogma_edges(t):
    return G.dogma_edges(t.part.select(F.col("p_brand").alias("gene")).distinct())


_GF = "f AS (SELECT DISTINCT p_brand || '_mrna_' || (p_size % 3) AS feature, p_brand AS gene, 1.0::DOUBLE AS weight FROM part WHERE p_size % 3 < 2)"


@query(ctes(EDGES, _GF) + f"""SELECT pathway_id, src, dst, weight FROM (
    SELECT pathway_id, gene || '_' || a AS src, gene || '_' || b AS dst, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT pathway_id, src AS gene FROM edges UNION SELECT pathway_id, dst FROM edges), {_CHAIN}
    UNION ALL SELECT pathway_id, feature, gene || '_mrna', weight FROM (SELECT DISTINCT pathway_id, src AS gene FROM edges UNION SELECT pathway_id, dst FROM edges) JOIN f USING (gene)
    UNION ALL SELECT pathway_id, src, dst, weight FROM edges)""")
def extend_pathways(t):
    s = F.col("p_size") % 3
    f = t.part.where(s < 2).select(F.concat_ws("_", "p_brand", F.lit("mrna"), s.cast("string")).alias("feature"), F.col("p_brand").alias("gene"), F.lit(1.0).alias("weight")).distinct()
    return G.extend_pathways(t.edges, f)


_LAP = ctes(EDGES) + """, u AS (SELECT pathway_id, least(src, dst) AS lo, greatest(src, dst) AS hi, arg_max(weight, pos) AS w FROM edges GROUP BY ALL),
    d AS (SELECT pathway_id, lo AS i, abs(w) AS a FROM u UNION ALL SELECT pathway_id, hi, abs(w) FROM u UNION ALL SELECT pathway_id, lo, -2 * w FROM u WHERE lo = hi),
    l AS (SELECT pathway_id, i, i AS j, sum(a) + 0.1 AS v FROM d GROUP BY ALL UNION ALL SELECT pathway_id, lo, hi, -w FROM u WHERE lo <> hi UNION ALL SELECT pathway_id, hi, lo, -w FROM u WHERE lo <> hi) """


@query(_LAP + "SELECT pathway_id, i, j, round(v, 6) AS v FROM l")
def laplacian(t):
    return G.laplacian(t.edges, 0.1, "pathway_id").withColumn("v", r("v"))


@query(_LAP + ", x AS (SELECT p_brand AS i, CAST(count(*) AS DOUBLE) / 50 AS x FROM part GROUP BY 1) SELECT pathway_id, round(sum(l.v * a.x * b.x), 5) AS q FROM l JOIN x a ON a.i = l.i JOIN x b ON b.i = l.j GROUP BY 1")
def laplacian_quadratic(t):
    x = t.part.groupBy(F.col("p_brand").alias("i")).agg((F.count(F.lit(1)) / 50).alias("x"))
    return G.quadratic_form(G.laplacian(t.edges, 0.1, "pathway_id"), x, "pathway_id").withColumn("q", r("q", 5))


@query(ctes(MEMBERS) + """, s AS (SELECT set_id, count(*) AS n FROM members GROUP BY 1), b AS (SELECT l.set_id AS a, m.set_id AS b, count(*) AS k FROM members l JOIN members m ON l.gene = m.gene AND l.set_id < m.set_id GROUP BY ALL)
    SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM b JOIN s x ON x.set_id = a JOIN s y ON y.set_id = b""")
def set_redundancy(t):
    return G.jaccard(t.members.select("set_id", F.col("gene").alias("member"))).withColumn("jaccard", r("jaccard"))


# ---------------------------------------------------------------- model, priors


_FWD = ctes(CELLS, FEATURES, BATCHES, X, Y) + _Z + """, p AS (SELECT sample_id, feature_id, view, distribution, (z * exp((j % 5 - 2) / 10.0::DOUBLE)) * exp(coalesce((batch - 2) / 20.0::DOUBLE, 0)) + (j % 7 - 3) + coalesce((batch - 2) / 4.0::DOUBLE, 0) AS z
    FROM z JOIN features USING (feature_id) LEFT JOIN batch_map USING (view, sample_id)) """


def _forward(t):
    f = t.features.select("feature_id", "view", "distribution", ((F.col("j") % 5 - 2) / 10.0).alias("logsigma"), (F.col("j") % 7 - 3).alias("mu"))
    j = _latent(t).join(f, "feature_id").join(t.batch_map, ["view", "sample_id"], "left")
    delta, theta = (F.coalesce((F.col("batch") - 2) / n, F.lit(0.0)) for n in (20.0, 4.0))
    return j.withColumn("z", F.col("z") * F.exp("logsigma") * F.exp(delta) + F.col("mu") + theta)


@query(_FWD + "SELECT sample_id, feature_id, round(z, 6) AS z FROM p")
def forward_model(t):
    return _forward(t).select("sample_id", "feature_id", r("z").alias("z"))


@query(_FWD + """, obs AS (SELECT sample_id, feature_id, view, avg(l_extendedprice) / 1.37 AS value FROM cells GROUP BY ALL)"""
    + _DISC + """, l AS (SELECT o.view, CASE o.distribution WHEN 'bernoulli' THEN ln(1 + exp(-abs(z))) + greatest(z, 0) - d * z WHEN 'poisson' THEN exp(z) - d * z ELSE 0.5 * pow(z - d, 2) END AS loss,
    CASE o.distribution WHEN 'bernoulli' THEN 1 / (1 + exp(-z)) - d WHEN 'poisson' THEN exp(z) - d ELSE z - d END AS g FROM p JOIN o USING (sample_id, feature_id))
    SELECT view, round(sum(loss), 2) AS loss, round(sum(g), 3) AS gradient FROM l GROUP BY 1""")
def data_loss_and_gradient(t):
    d = _forward(t).drop("view", "distribution").join(_typed(t).select("sample_id", "feature_id", "view", "distribution", "d"), ["sample_id", "feature_id"])
    args = F.col("distribution"), F.col("z"), F.col("d")
    return d.groupBy("view").agg(r(F.sum(S.data_loss(*args)), 2).alias("loss"), r(F.sum(S.data_gradient(*args)), 3).alias("gradient"))


def _weights(t, *cols):
    return t.spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.25)], "k int, w double")


_W = "w AS (SELECT k, w FROM (VALUES (0, 1.0::DOUBLE), (1, 0.5), (2, 0.25)) v(k, w))"


@query(ctes(CELLS, FEATURES, Y, _W) + "SELECT round(0.5 * sum(w * v * v), 6) AS l2, round(sum(w * abs(v)), 6) AS l1, round(1.501 * sum(ln(1 + v * v / 0.002)), 4) AS ard FROM y JOIN w USING (k)")
def penalties(t):
    y, w = t.y(), _weights(t)
    return P.l2(y, w).toDF("l2").crossJoin(P.l1(y, w).toDF("l1")).crossJoin(P.ard(y).toDF("ard")).select(r("l2").alias("l2"), r("l1").alias("l1"), r("ard", 4).alias("ard"))


@query(ctes(CELLS, FEATURES, Y, _W) + """, used AS (SELECT DISTINCT p_size - 1 AS k, p_brand AS gene FROM part)
    SELECT round(sum(w * abs(v)), 6) AS loss FROM y JOIN w USING (k) WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.k = y.k AND u.gene = y.gene)""")
def selective_l1(t):
    # the graph of factor k holds the brands of parts of size k + 1
    e = t.part.select((F.col("p_size") - 1).alias("pathway_id"), F.col("p_brand").alias("src"), F.col("p_brand").alias("dst"))
    graphs = t.spark.createDataFrame([(0,), (1,), (2,)], "pathway_id int")
    out = J.outside_graphs(t.features.select(F.col("gene").alias("node")).distinct(), e, graphs)
    mask = out.join(t.features, F.col("node") == F.col("gene")).select(F.col("pathway_id").alias("k"), "feature_id")
    return P.selective_l1(t.y(), mask, _weights(t)).select(r("loss").alias("loss"))


@query(ctes(SAMPLES, X) + """, g AS (SELECT DISTINCT condition, k, (condition + k + 1) / 10.0::DOUBLE AS w FROM x) SELECT round(0.5 * sum(w * v * v), 5) AS loss FROM x JOIN g USING (condition, k)""")
def group_penalty(t):
    x = t.x()
    w = x.select("condition", "k", ((F.col("condition") + F.col("k") + 1) / 10.0).alias("w")).distinct()
    return P.group_l2(x, "condition", w).select(r("loss", 5).alias("loss"))


_SETS = ctes(CELLS, FEATURES, MEMBERS, Y) + """, s0 AS (SELECT DISTINCT view, set_id, feature_id FROM members JOIN features USING (gene)),
    s AS (SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY view, set_id)) AS weight FROM s0),
    a AS (SELECT view, set_id, k, CASE WHEN (length(set_id) + k) % 3 = 0 THEN 0.5::DOUBLE ELSE 0.0 END AS a FROM (SELECT DISTINCT view, set_id FROM s), range(3) r(k)),
    m AS (SELECT k, view, feature_id, sum(a * weight) AS am FROM a JOIN s USING (view, set_id) GROUP BY ALL),
    b AS (SELECT y.*, 0.001 * (0.8 + coalesce(am, 0)) AS beta FROM y LEFT JOIN m USING (k, view, feature_id)) """


def _set_scales(t):
    s = J.set_weights(J.feature_sets_by_view(t.members, t.features))
    a = s.select("view", "set_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return P.set_scales(a.withColumn("a", F.when((F.length("set_id") + F.col("k")) % 3 == 0, 0.5).otherwise(0.0)), s, t.y())


@query(_SETS + "SELECT round(sum(1.501 * ln(1 + v * v / (2 * beta))), 4) AS loss FROM b")
def fsard_penalty(t):
    return P.feature_set_ard(_set_scales(t)).select(r("loss", 4).alias("loss"))


@query(_SETS + "SELECT round(sum(1.501 * ln(beta + 0.5 * v * v)) - sum(1.001 * ln(beta)), 4) AS loss FROM b")
def gamma_normal_loss(t):
    return P.gamma_normal(_set_scales(t)).select(r("loss", 4).alias("loss"))


@query(_SETS + "SELECT k, feature_id, round(3.002 * v / (2 * beta + v * v), 5) AS g FROM b")
def fsard_gradient(t):
    return P.gradients(_set_scales(t), "ard").select(F.col("k").cast("long").alias("k"), "feature_id", r("g", 5).alias("g"))


@query(ctes(CELLS, FEATURES, Y) + "SELECT k, round(1 / nullif(var_samp(v), 0), 5) AS w FROM y GROUP BY 1")
def eb_weights_l1(t):
    return P.eb_l1(t.y()).select(F.col("k").cast("long").alias("k"), r("w", 5).alias("w"))


@query(ctes(CELLS, FEATURES, BATCHES) + "SELECT view, batch, round(avg(batch_value), 6) AS centre, round(coalesce(1 / nullif(var_samp(batch_value), 0), 1 + count(*) / 2), 5) AS w FROM batch_values GROUP BY ALL")
def eb_weights_batch(t):
    return P.eb_batch_prior(t.batch_values).select("view", "batch", r("centre").alias("centre"), r("w", 5).alias("w"))


@query(ctes(CELLS, FEATURES) + "SELECT view, round(avg(v), 6) AS centre, round(0.6 / (0.1 + 0.5 * var_samp(v)), 6) AS w FROM (SELECT view, (j % 7 - 3)::DOUBLE AS v FROM features) GROUP BY 1")
def eb_weights_column(t):
    return P.eb_column_prior(t.features.select("view", (F.col("j") % 7 - 3).cast("double").alias("v")), "view").select("view", r("centre").alias("centre"), r("w").alias("w"))


@query(ctes(CELLS, FEATURES, Y) + "SELECT a.view, a.k AS k1, b.k AS k2, round(sum(a.v * b.v), 6) AS v FROM y a JOIN y b USING (view, feature_id) GROUP BY ALL")
def factor_gram(t):
    return P.gram(t.y(), "feature_id", "view").select("view", F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"), r("v").alias("v"))


_EM = """, o AS (SELECT sample_id, feature_id, view, value / 10000 AS value FROM obs), r AS (SELECT o.*, value - avg(value) OVER (PARTITION BY feature_id, condition) AS r FROM o JOIN samples USING (sample_id)),
    s2 AS (SELECT feature_id, coalesce(nullif(var_pop(r), 0), 1) AS sigma2 FROM r GROUP BY 1),
    s0 AS (SELECT view, batch, feature_id, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM r JOIN batch_map USING (view, sample_id) GROUP BY ALL),
    st AS (SELECT *, s / n AS tl, s / n AS theta, coalesce(nullif(greatest(q / n - (s / n) * (s / n), 0), 0) / sigma2, 1) AS delta2 FROM s0 JOIN s2 USING (feature_id)),
    pr AS (SELECT view, batch, avg(theta) AS tm, coalesce(var_samp(theta), 1) AS tv, avg(delta2) AS dm, coalesce(var_samp(delta2), 0) AS dv FROM st GROUP BY ALL),
    e1 AS (SELECT st.* EXCLUDE (theta, delta2), delta2 AS d0, dm, dv, (tm * delta2 * sigma2 + tl * n * tv) / (delta2 * sigma2 + n * tv) AS theta FROM st JOIN pr USING (view, batch)),
    e2 AS (SELECT *, (dm * (1 + dm * dm / (dv + 1e-9)) + 0.5 * (q - 2 * theta * s + n * theta * theta) / sigma2) / (2 + dm * dm / (dv + 1e-9) + 0.5 * n - 1) AS delta2 FROM e1) """


@query(ctes(OBS, FEATURES, BATCHES) + _EM + "SELECT view, batch, feature_id, round(theta, 5) + 0.0::DOUBLE AS theta, round(delta2, 5) AS delta2 FROM e2")
def batch_em_one_round(t):
    o = t.obs.select("sample_id", "feature_id", "view", (F.col("value") / 10000).alias("value"))
    state = B.em_round(B.least_squares_start(B.residual_statistics(o, t.batch_map, t.samples)))
    return state.select("view", "batch", "feature_id", (r("theta", 5) + 0.0).alias("theta"), r("delta2", 5).alias("delta2"))


@query(ctes(OBS, FEATURES, BATCHES) + """SELECT sample_id, feature_id, round((value / 10000 - (j % 7 - 3) - coalesce((batch - 2) / 4.0::DOUBLE, 0)) / exp(coalesce((batch - 2) / 20.0::DOUBLE, 0)) + (j % 7 - 3), 5) AS value
    FROM obs JOIN features USING (feature_id, view) LEFT JOIN batch_map USING (view, sample_id)""")
def remove_batch_exact(t):
    b = F.col("batch") - 2
    p = t.batch_map.select("view", "batch").distinct().join(t.features.select("view", "feature_id"), "view").select("view", "batch", "feature_id", (b / 4.0).alias("theta"), (b / 20.0).alias("logdelta"))
    o = t.obs.select("sample_id", "feature_id", "view", (F.col("value") / 10000).alias("value"))
    mu = t.features.select("feature_id", (F.col("j") % 7 - 3).alias("mu"))
    # mu holds for unbatched views too, so shift around it
    shifted = o.join(mu, "feature_id").withColumn("value", F.col("value") - F.col("mu"))
    out = B.remove_batch(shifted.drop("mu"), t.batch_map, p.withColumn("mu", F.lit(0.0)))
    return out.join(mu, "feature_id").select("sample_id", "feature_id", r(F.col("value") + F.col("mu"), 5).alias("value"))


@query(ctes(SAMPLES, X) + "SELECT sample_id, k, round(v / sqrt(avg(v * v) OVER (PARTITION BY k)), 6) AS v FROM x")
def whiten_factors(t):
    x = t.x()
    rms = x.groupBy("k").agg(F.sqrt(F.avg(F.col("v") ** 2)).alias("rms"))
    return x.join(F.broadcast(rms), "k").select("sample_id", F.col("k").cast("long").alias("k"), r(F.col("v") / F.col("rms")).alias("v"))


# ---------------------------------------------------------------- splits, scores


@query("""SELECT fold, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) > 0 AS both FROM (SELECT quality, (row_number() OVER (PARTITION BY quality) - 1) % 5 AS fold FROM labels) GROUP BY 1""")
def cv_fold_sizes(t):
    f = D.cv_folds(t.labels.select(F.col("doc_id").alias("sample_id"), "quality"), 5, "quality")
    return f.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), (F.sum((F.col("quality") == 1).cast("int")) > 0).alias("both"))


@query(ctes(BATCHES.split(",\nbatch_values")[0]) + """, s AS (SELECT view, batch, count(*) AS size, (batch * 7 + length(view)) % 5 AS o FROM batch_map GROUP BY ALL),
    q AS (SELECT view, batch, greatest(least(round_even(0.3 * sum(size) OVER (PARTITION BY view), 0) - coalesce(sum(size) OVER (PARTITION BY view ORDER BY o, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), size), 0) AS quota FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY view, batch ORDER BY sample_id) AS nth FROM batch_map) SELECT view, sample_id FROM n JOIN q USING (view, batch) WHERE nth <= quota""")
def missingness_mask(t):
    return D.batch_missingness(t.batch_map, 0.3, (F.col("batch") * 7 + F.length("view")) % 5)


_PRED = "(SELECT CAST(l_linenumber % 3 AS INTEGER) AS y, CAST((l_orderkey + l_linenumber) % 3 AS INTEGER) AS p FROM lineitem)"


@query(f"""WITH c AS (SELECT y, p, count(*) AS n FROM {_PRED} GROUP BY ALL), k AS (SELECT DISTINCT y AS l FROM c UNION SELECT p FROM c),
    s AS (SELECT l, coalesce((SELECT sum(n) FROM c WHERE y = l), 0) AS t, coalesce((SELECT sum(n) FROM c WHERE p = l), 0) AS q, coalesce((SELECT sum(n) FROM c WHERE y = l AND p = l), 0) AS tp FROM k)
    SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(2 * sum(tp) / (sum(t) + sum(q)), 6) AS f1_micro, round(avg(coalesce(2 * tp / nullif(t + q, 0), 0)), 6) AS f1_macro FROM s""")
def classifier_scores(t):
    d = t.lineitem.select((F.col("l_linenumber") % 3).cast("int").alias("y"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int").alias("p"))
    return E.classification_scores(d, "y", "p").select(*(r(c).alias(c) for c in ("accuracy", "f1_micro", "f1_macro")))


@query("""SELECT round(avg(pow(l_quantity - l_extendedprice / 1500, 2)), 4) AS mse, round(1 - avg(pow(l_quantity - l_extendedprice / 1500, 2)) / var_pop(l_quantity), 6) AS r2, round(var_pop(l_quantity), 4) AS baseline_mse FROM lineitem""")
def regressor_scores(t):
    s = E.regression_scores(t.lineitem.select("l_quantity", (F.col("l_extendedprice") / 1500).alias("p")), "l_quantity", "p")
    return s.select(r("mse", 4).alias("mse"), r("r2").alias("r2"), r("baseline_mse", 4).alias("baseline_mse"))


@query("""WITH s AS (SELECT s_suppkey AS t, s_suppkey % 3 = 0 AS dead, round(s_acctbal / 500) AS risk FROM supplier), p AS (SELECT a.risk AS ra, b.risk AS rb FROM s a JOIN s b ON a.dead AND (b.t > a.t OR (b.t = a.t AND NOT b.dead)))
    SELECT round(coalesce(sum(CASE WHEN ra > rb THEN 1.0 WHEN ra = rb THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 0.5), 6) AS concordance FROM p""")
def concordance(t):
    d = t.supplier.select(F.col("s_suppkey").alias("t"), (F.col("s_suppkey") % 3 == 0).alias("dead"), F.round(F.col("s_acctbal") / 500).alias("risk"))
    return E.concordance(d, "t", "dead", "risk").select(r("concordance").alias("concordance"))


@query("""SELECT event_id % 4 AS K, (event_id // 4) % 3 AS rep, round(avg(value), 5) AS score FROM events GROUP BY ALL""")
def tabulate_scores(t):
    e = F.col("event_id")
    runs = t.events.select(F.concat(F.lit("out/K="), (e % 4).cast("string"), F.lit("__rep="), (F.floor(e / 4) % 3).cast("string"), F.lit("/score.json")).alias("path"), F.create_map(F.lit("s"), F.col("value").cast("string")).alias("content"))
    tab = R.tabulate(runs, ["K", "rep", "s"])
    return tab.groupBy(F.col("K").cast("long").alias("K"), F.col("rep").cast("long").alias("rep")).agg(r(F.avg(F.col("s").cast("double")), 5).alias("score"))


@query(ctes(OBS, FEATURES, MEMBERS) + """, v AS (SELECT view, feature_id, var_samp(value) AS variance FROM obs GROUP BY ALL),
    cut AS (SELECT view, quantile_cont(variance, 0.77) AS cut FROM v GROUP BY 1), top AS (SELECT view, feature_id FROM v JOIN cut USING (view) WHERE variance >= cut),
    s AS (SELECT DISTINCT f.view, set_id, f.feature_id FROM members JOIN features f USING (gene) JOIN top ON top.feature_id = f.feature_id)
    SELECT view, set_id, feature_id, round(1 / sqrt(count(*) OVER (PARTITION BY view, set_id)), 6) AS weight FROM s""")
def variable_feature_sets(t):
    """Flagship: variance filter per view, then feature sets of what is left, empty sets dropped, 1/sqrt(n) weights."""
    top = L.top_variance(t.obs, 0.23).select("feature_id", "view")
    sets = J.feature_sets_by_view(t.members, top.withColumn("gene", F.split("feature_id", "_")[0]))
    return J.set_weights(sets).withColumn("weight", r("weight"))
