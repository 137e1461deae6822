"""Order over whole tables without a task that holds them: range buckets and offsets.

Rows are dealt to buckets by ranges of their order and written once; a bucket's
rows are numbered by themselves and counts of the buckets before give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.scratch import save

BUCKET = "__bucket"


def buckets(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with the number of its range bucket, written once; equal keys share a bucket, buckets follow the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(df.repartitionByRange(n, *order).withColumn(BUCKET, F.spark_partition_id()), "ranged")


def carried(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """(by, bucket, and for each sum its total in the earlier buckets); ``df`` comes from :func:`buckets`."""
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*by, BUCKET).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    return per.select(*by, BUCKET, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums))


def joined(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of a table by (by, bucket); nulls in ``by`` match."""
    left, right = df.alias("l"), table.alias("r")
    on = F.col(f"l.{BUCKET}") == F.col(f"r.{BUCKET}")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    new = [c for c in table.columns if c not in (*by, BUCKET)]
    return left.join(right, on).select("l.*", *(F.col(f"r.{c}") for c in new))


def positions(df: DataFrame, by: list[str], *order: Column, name: str = "pos") -> DataFrame:
    """``df`` with the place of each row, from 1, in its group and ``order``."""
    held = buckets(df, *by, *order)
    placed = joined(held, carried(held, by, __before=F.lit(1)), by)
    own = F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(*order))
    return placed.withColumn(name, own + F.col("__before")).drop("__before", BUCKET)


def quantile(df: DataFrame, value: str, share: float, *by: str, name: str = "quantile") -> DataFrame:
    """(by, name): the exact quantile of each group, between two values in proportion; nulls are left out.

    Distinct values with their counts are ranged, so neither a long group nor a
    common value is held by one task.
    """
    by = list(by)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    held = buckets(distinct, *by, "__v")
    total = held.groupBy(*by).agg((F.sum("__n") - 1).alias("__last"))
    placed = joined(held, carried(held, by, __before=F.col("__n")), by)
    own = Window.partitionBy(*by, BUCKET).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__before") + F.coalesce(F.sum("__n").over(own), F.lit(0))
    ranked = placed.withColumn("__first", first).drop("__before").alias("p")
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}"))
    both = ranked.join(total.alias("t"), on).select(*(F.col(f"p.{c}") for c in by), "__v", "__n", "__first", "__last")
    at = F.lit(share) * F.col("__last")
    low, high = F.floor(at), F.ceil(at)
    inside = lambda k: (F.col("__first") <= k) & (k < F.col("__first") + F.col("__n"))
    ends = both.where(inside(low) | inside(high)).groupBy(*by).agg(F.max(F.when(inside(low), F.col("__v"))).alias("a"), F.max(F.when(inside(high), F.col("__v"))).alias("b"), F.max(at - low).alias("f"))
    return ends.select(*by, (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias(name))
