"""Sources and sinks: edge lists, set collections, wide tables, models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.scalars import finite
from strandloom.functions.strings import interaction_code

SIF = "src STRING, itype STRING, dst STRING"


def read_sif(spark: SparkSession, *paths: str) -> DataFrame:
    """Headerless tab-separated edges: file, src, itype, dst."""
    return spark.read.csv(list(paths), sep="\t", schema=SIF, quote="").select(F.input_file_name().alias("file"), "src", "itype", "dst")


def name_sif(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with the name of their collection, from the number at the end of the file name.

    ``names``: id, name.  Files without a name keep their number.
    """
    numbered = edges.withColumn("id", F.regexp_extract("file", r"_(\d+)\.[^/]*$", 1))
    return numbered.join(names.select(F.col("id").cast("string").alias("id"), "name"), "id", "left").select(F.coalesce("name", "id").alias("name"), "src", "itype", "dst")


def read_collection(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(name, pos, src, itype, dst) of a JSON object with parallel arrays ``names`` and ``pathways``.

    ``lines``: an object on each line, as :func:`write_collection` writes them.
    """
    raw = spark.read.json(path, multiLine=not lines, schema="names ARRAY<STRING>, pathways ARRAY<ARRAY<ARRAY<STRING>>>")
    named = raw.select(F.inline(F.arrays_zip("names", "pathways")))
    return named.select(F.col("names").alias("name"), F.posexplode("pathways").alias("pos", "e")).select("name", "pos", F.col("e")[0].alias("src"), F.col("e")[1].alias("itype"), F.col("e")[2].alias("dst"))


def write_collection(edges: DataFrame, path: str) -> None:
    """The inverse of :func:`read_collection` (one row per collection, JSON lines of names and edges)."""
    e = F.array("src", "itype", "dst")
    sets = edges.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", e.alias("e")))), lambda s: s["e"]).alias("edges"))
    sets.select(F.array("name").alias("names"), F.array("edges").alias("pathways")).write.mode("overwrite").json(path)


def read_gene_sets(spark: SparkSession, *paths: str) -> DataFrame:
    """Gene sets {set: {geneSymbols: [...]}} of several JSON files as self edges of weight 1."""
    text = spark.read.text(list(paths), wholetext=True)
    sets = text.select(F.explode(F.from_json("value", "MAP<STRING, STRUCT<geneSymbols: ARRAY<STRING>>>")).alias("name", "body"))
    return self_edges(sets.select("name", F.explode("body.geneSymbols").alias("gene")))


def self_edges(members: DataFrame) -> DataFrame:
    """(name, src, dst, weight): an edge of each member of a set to itself."""
    return members.select("name", F.col("gene").alias("src"), F.col("gene").alias("dst"), F.lit(1.0).alias("weight"))


def first_block(lines: DataFrame, at: str = "line_no", text: str = "value") -> DataFrame:
    """The lines before the first blank one (all if there is none)."""
    end = lines.where(F.trim(text) == "").agg(F.min(at).alias("end"))
    return lines.join(F.broadcast(end), F.coalesce(F.col(at) < F.col("end"), F.lit(True))).drop("end")


def read_extended_sif(spark: SparkSession, path: str) -> DataFrame:
    """First block of a tab-separated file with header: (name, src, itype, dst), names exploded, distinct.

    The driver needs line numbers, so the file is read as one row.
    """
    text = spark.read.text(path, wholetext=True)
    lines = first_block(text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")))
    part = F.split("value", "\t")
    head = lines.where("line_no = 0").select(part.alias("head"))
    body = lines.where("line_no > 0").crossJoin(F.broadcast(head))
    col = lambda n: F.get(part, F.array_position("head", F.lit(n)).cast("int") - 1)
    rows = body.select(col("PARTICIPANT_A").alias("src"), interaction_code(col("INTERACTION_TYPE")).alias("itype"), col("PARTICIPANT_B").alias("dst"), col("PATHWAY_NAMES").alias("names"))
    return explode_names(rows)


def explode_names(rows: DataFrame, sep: str = ";") -> DataFrame:
    """A row for each name in ``names``; null and empty names are skipped, repeats dropped."""
    out = rows.where(F.col("names").isNotNull()).withColumn("name", F.explode(F.split("names", sep))).where("name <> ''")
    return out.select("name", *[c for c in rows.columns if c != "names"]).distinct()


def wide_to_long(wide: DataFrame, key: str, variable: str = "sample_id", value: str = "value") -> DataFrame:
    """Unpivot all columns but ``key``; non-finite values become NULL."""
    names = [c for c in wide.columns if c != key]
    long = wide.select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(key, names, variable, value)
    return long.withColumn(value, finite(F.col(value)))


def read_wide_tsv(spark: SparkSession, path: str, key: str = "feature_id") -> DataFrame:
    """Features x samples with an index column -> (feature_id, sample_id, value)."""
    wide = spark.read.csv(path, sep="\t", header=True)
    return wide_to_long(wide.withColumnRenamed(wide.columns[0], key), key)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def key_value_map(keys: DataFrame) -> DataFrame:
    """One map from (key, value) rows."""
    return keys.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("map"))


def save_tables(path: str, tables: dict[str, DataFrame], meta: dict) -> None:
    """A model as a folder of Parquet tables and one row of JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(tables.values())).sparkSession.createDataFrame([(json.dumps(meta | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}, meta


def write_splits(df: DataFrame, path: str, *by: str) -> None:
    """Rows in a folder for each value of ``by`` (split, fold), so that a reader of one opens only its files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_matrix(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """A labelled matrix in the canonical schema (Parquet obs: sample_id, feature_id, view, value), values as doubles.

    ``target``: name of a table (sample_id, target) beside it; without one every
    sample has the target 1.
    """
    obs = spark.read.parquet(f"{path}/obs").withColumn("value", finite(F.col("value").cast("double")))
    if target is None:
        return obs.withColumn("target", F.lit(1.0))
    return obs.join(spark.read.parquet(f"{path}/{target}").select("sample_id", "target"), "sample_id", "left")


def batch_ids(batch_values: DataFrame, order: str = "pos") -> DataFrame:
    """(view, batch, first, features) of an exported table of batch values, by first occurrence."""
    return batch_values.groupBy("view", "batch").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("features"))
