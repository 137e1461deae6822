"""Pivots, indicator columns, record merging, restoring order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.strings import path_pairs


def pivot_grid(df: DataFrame, row: str, col: str, value: str, names: list) -> DataFrame:
    """One row per ``row``, one column per name; the names are given, so no extra job finds them."""
    return df.groupBy(row).pivot(col, names).agg(F.first(value, ignorenulls=True))


def indicator(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """A 0/1 column for each name."""
    return df.select("*", *((F.col(col) == n).cast("double").alias(f"is_{n}") for n in names))


def grouped_lists(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))


def restore_order(full: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """All rows of ``full`` with the columns of ``part``, NULL where it has no row."""
    return full.join(part, key, "left")


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def merge_records(path: Column, content: Column) -> Column:
    """Keys of a path and of a record as one map; the record wins."""
    pairs = path_pairs(path)
    own = F.map_from_entries(F.filter(pairs, lambda p: ~F.map_contains_key(content, p["k"])))
    return F.map_concat(own, content)


def tabulate(records: DataFrame, names: list[str]) -> DataFrame:
    """Records (path, content map) as columns."""
    merged = records.withColumn("__m", merge_records(F.col("path"), F.col("content")))
    return merged.select(*(F.col("__m")[n].alias(n) for n in names))
