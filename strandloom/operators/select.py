"""Filters, selections and top-k over long matrices obs(sample_id, feature_id, view, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ranged import positions


def keep(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def drop(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def by_groups(samples: DataFrame, group: str, kept: list[str] = (), held_out: list[str] = ()) -> DataFrame:
    """In ``kept`` (empty: all) and not in ``held_out``."""
    out = samples.where(F.col(group).isin(*kept)) if kept else samples
    return out.where(~F.col(group).isin(*held_out)) if held_out else out


def column_counts(obs: DataFrame, by: str = "feature_id") -> DataFrame:
    return obs.groupBy(by).agg(F.count("value").alias("n_finite"), F.count(F.lit(1)).alias("n"))


def count_filter(obs: DataFrame, least: int, by: str = "feature_id") -> DataFrame:
    """Rows of the columns (or rows) of the matrix with more than ``least`` finite values."""
    return keep(obs, column_counts(obs, by).where(F.col("n_finite") > least), by)


def missing_fraction_filter(obs: DataFrame, samples: DataFrame, most: float, by: str = "feature_id") -> DataFrame:
    """Columns missing in less than ``most`` of all samples."""
    total = samples.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    ok = column_counts(obs, by).crossJoin(F.broadcast(total)).where(F.col("total") - F.col("n_finite") < most * F.col("total"))
    return keep(obs, ok, by)


def variances(obs: DataFrame, *by: str, population: bool = False) -> DataFrame:
    return obs.groupBy(*by).agg((F.var_pop if population else F.var_samp)("value").alias("variance"))


def top_variance(obs: DataFrame, fraction: float, within: str = "view") -> DataFrame:
    """(view, feature_id, variance): features with variance >= the (1 - fraction) quantile of their view.

    The cut is taken from the same variances that it is held against: computed
    twice, they may differ in the last digits, and the feature at the cut is lost.
    """
    var = variances(obs, within, "feature_id").where("variance is not null")
    cut = F.percentile("variance", F.lit(1 - fraction)).over(Window.partitionBy(within))
    return var.withColumn("cut", cut).where(F.col("variance") >= F.col("cut")).drop("cut")


def composite_filter(obs: DataFrame, least: int, fraction: float) -> DataFrame:
    """Count filter, then variance filter in each view."""
    return top_variance(count_filter(obs, least), fraction)


def sample_quality(obs: DataFrame, view: str, least: int = 50, share: float = 0.05) -> DataFrame:
    """(sample_id, n): samples with more than ``least`` finite values among the view's most variable features.

    Of features with more than ``least`` values the top floor(share * n) by variance are used.
    """
    own = count_filter(obs.where(F.col("view") == view), least)
    var = variances(own, "feature_id")
    k = var.count()
    top = var.orderBy(F.col("variance").desc_nulls_last(), "feature_id").limit(int(share * k))
    return keep(own, top, "feature_id").groupBy("sample_id").agg(F.count("value").alias("n")).where(F.col("n") > least)


def target_available(kind: str, *cols: str) -> Column:
    """Whether a supervised target is there; 'nan' and 'indeterminate' are not."""
    if kind == "ctype":
        return F.lit(True)
    if kind == "survival":
        return F.coalesce(F.col(cols[0]) != "nan", F.lit(False)) | F.coalesce(F.col(cols[1]) != "nan", F.lit(False))
    return F.coalesce(~F.col(cols[0]).isin("nan", "indeterminate"), F.lit(False))


def rectangle(coo: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Entries (i, j, v) inside inclusive ranges, indices counted from the range's start."""
    inside = F.col("i").between(*rows) & F.col("j").between(*cols)
    return coo.where(inside).select((F.col("i") - rows[0]).alias("i"), (F.col("j") - cols[0]).alias("j"), "v")


def gather(coo: DataFrame, picks: DataFrame) -> DataFrame:
    """Row ``old`` of the matrix as row ``new`` for each pick (new, old)."""
    return coo.join(picks, F.col("i") == F.col("old")).select(F.col("new").alias("i"), "j", "v")


def feature_index(features: DataFrame) -> DataFrame:
    """feature_idx from 0 in the order distribution, view, id (features fit one task)."""
    return features.withColumn("feature_idx", F.row_number().over(Window.orderBy("distribution", "view", "feature_id")) - 1)


def by_condition(samples: DataFrame, raw: str = "raw_idx") -> DataFrame:
    """samples with ``sample_idx`` from 0 in the order condition, raw index."""
    return positions(samples, [], F.col("condition"), F.col(raw), name="sample_idx").withColumn("sample_idx", F.col("sample_idx") - 1)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def smallest_groups_first(samples: DataFrame, group: str, m: int) -> DataFrame:
    """``m`` samples, those of small groups first."""
    size = samples.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return samples.join(size, group).orderBy("size", group, "sample_id").limit(m)


def by_vocabulary(df: DataFrame, col: str, words: list[str]) -> DataFrame:
    """Rows ordered by the place of ``col`` in a list."""
    place = F.array_position(F.array(*map(F.lit, words)), F.col(col))
    return df.withColumn("pos", place.cast("int")).orderBy("pos")
