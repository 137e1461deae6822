"""The canonical matrix view of a folder of tables, and its SQL.

Samples are suppliers, features are (brand, return flag), a feature's view is
its return flag and its gene its brand; a value is the mean extended price over a
constant, which keeps means of whole cents away from rounding ties.
Batches are supplier regions, in views A and R only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: noise model of each view, for operators that need one
VIEW_DISTRIBUTION = {"A": "normal", "N": "bernoulli", "R": "poisson"}


class Tables:
    """Tables of ``sf_dir`` by name, and the derived views, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def cells(self) -> DataFrame:
        """Line items with sample and feature."""
        part = self.part.select("p_partkey", F.col("p_brand").alias("gene"), "p_type")
        j = self.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        return j.withColumn("sample_id", F.col("l_suppkey")).withColumn("view", F.col("l_returnflag")).withColumn("feature_id", F.concat_ws("_", "gene", "l_returnflag"))

    @cached_property
    def obs(self) -> DataFrame:
        return self.cells.groupBy("sample_id", "feature_id", "view", "gene").agg((F.avg("l_extendedprice") / 1.37).alias("value"))

    @cached_property
    def features(self) -> DataFrame:
        """feature_id, view, gene, distribution, j (place in view, gene order)."""
        from pyspark.sql import Window

        f = self.cells.select("feature_id", "view", "gene").distinct()
        dist = F.create_map(*(F.lit(x) for kv in VIEW_DISTRIBUTION.items() for x in kv))
        return f.withColumn("distribution", dist[F.col("view")]).withColumn("j", F.row_number().over(Window.orderBy("view", "gene")) - 1)

    @cached_property
    def samples(self) -> DataFrame:
        s = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("condition"), F.col("n_regionkey").alias("region"))

    @cached_property
    def batch_map(self) -> DataFrame:
        views = F.explode(F.array(F.lit("A"), F.lit("R"))).alias("view")
        return self.samples.select(views, "sample_id", F.col("region").alias("batch"))

    @cached_property
    def batch_values(self) -> DataFrame:
        """A value per (view, batch, feature) from the ids alone."""
        grid = self.batch_map.select("view", "batch").distinct().join(self.features.select("view", "feature_id", "j"), "view")
        return grid.select("view", "batch", "feature_id", (((F.col("batch") * 37 + F.col("j") * 11) % 19 + 1) / 10.0).alias("batch_value"))

    def x(self, k: int = 3) -> DataFrame:
        """Deterministic sample factors (k, sample_id, condition, v)."""
        grid = self.samples.select("sample_id", "condition", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
        return grid.withColumn("v", ((F.col("sample_id") * 7919 + F.col("k") * 10473 + 17) % 1000) / 500.0 - 1)

    def y(self, k: int = 3) -> DataFrame:
        """Deterministic feature factors (k, feature_id, view, v)."""
        grid = self.features.select("feature_id", "view", "distribution", "gene", "j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
        return grid.withColumn("v", ((F.col("j") * 6101 + F.col("k") * 3571 + 29) % 1000) / 500.0 - 1)

    @cached_property
    def edges(self) -> DataFrame:
        """pathway_id (part type), pos, src, dst (brands), weight: neighbours by part key of the same type."""
        return self._edges(F.col("p_type"))

    @cached_property
    def small_edges(self) -> DataFrame:
        """The same with a pathway for each type and size: many small, sparse graphs."""
        return self._edges(F.concat_ws("_", "p_type", F.col("p_size").cast("string")))

    def _edges(self, pathway: Column) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy(pathway).orderBy("p_partkey")
        e = self.part.select(pathway.alias("pathway_id"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("src"), F.lead("p_brand").over(w).alias("dst"), F.when(F.col("p_size") % 3 == 0, -1.0).otherwise(1.0).alias("weight"))
        return e.where(F.col("dst").isNotNull())

    @cached_property
    def members(self) -> DataFrame:
        """set_id (part type and size group), gene."""
        return self.part.select(F.concat_ws("_", "p_type", (F.col("p_size") % 10).cast("string")).alias("set_id"), F.col("p_brand").alias("gene")).distinct()


# SQL of the same views, as common table expressions
CELLS = """cells AS (SELECT *, l_suppkey AS sample_id, l_returnflag AS view, p_brand AS gene, p_brand || '_' || l_returnflag AS feature_id
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
OBS = CELLS + """,
obs AS (SELECT sample_id, feature_id, view, gene, avg(l_extendedprice) / 1.37 AS value FROM cells GROUP BY ALL)"""
FEATURES = """features AS (SELECT *, CASE view WHEN 'A' THEN 'normal' WHEN 'N' THEN 'bernoulli' ELSE 'poisson' END AS distribution,
    row_number() OVER (ORDER BY view, gene) - 1 AS j FROM (SELECT DISTINCT feature_id, view, gene FROM cells))"""
SAMPLES = """samples AS (SELECT s_suppkey AS sample_id, s_nationkey AS condition, n_regionkey AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
BATCHES = SAMPLES + """,
batch_map AS (SELECT v AS view, sample_id, region AS batch FROM samples, (VALUES ('A'), ('R')) AS t(v)),
batch_values AS (SELECT view, batch, feature_id, ((batch * 37 + j * 11) % 19 + 1) / 10.0::DOUBLE AS batch_value
    FROM (SELECT DISTINCT view, batch FROM batch_map) JOIN features USING (view))"""
X = """x AS (SELECT sample_id, condition, k, ((sample_id * 7919 + k * 10473 + 17) % 1000) / 500.0::DOUBLE - 1 AS v FROM samples, range(3) AS t(k))"""
Y = """y AS (SELECT feature_id, view, distribution, gene, j, k, ((j * 6101 + k * 3571 + 29) % 1000) / 500.0::DOUBLE - 1 AS v FROM features, range(3) AS t(k))"""
EDGES = """edges AS (SELECT * FROM (SELECT p_type AS pathway_id, p_partkey AS pos, p_brand AS src,
    lead(p_brand) OVER (PARTITION BY p_type ORDER BY p_partkey) AS dst, CASE WHEN p_size % 3 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS weight FROM part) WHERE dst IS NOT NULL)"""
SMALL_EDGES = EDGES.replace("edges AS", "small_edges AS").replace("p_type AS", "p_type || '_' || CAST(p_size AS VARCHAR) AS").replace("BY p_type", "BY p_type, p_size")
MEMBERS = """members AS (SELECT DISTINCT p_type || '_' || CAST(p_size % 10 AS VARCHAR) AS set_id, p_brand AS gene FROM part)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def dense(t: Tables) -> DataFrame:
    """The embeddings as obs: sample = vec_id, feature = dimension, two views of half the dimensions, condition = label."""
    long = t.embeddings.select(F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("condition"), F.posexplode("embedding").alias("d", "value"))
    return long.select("sample_id", "condition", F.format_string("d%02d", "d").alias("feature_id"), F.when(F.col("d") < 32, "low").otherwise("high").alias("view"), F.col("value").cast("double").alias("value"))
