"""Order-dependent operators: islands, curves, elbows, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.ranged import BUCKET, buckets


def ranges(df: DataFrame, id_col: str, pos: str, *by: str) -> DataFrame:
    """(id, start, stop, contiguous): the range of positions of each id and whether it has no gaps."""
    g = df.groupBy(*by, id_col).agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, id_col, "start", "stop", (F.col("stop") - F.col("start") + 1 == F.col("n")).alias("contiguous"))


def is_contiguous(df: DataFrame, id_col: str, pos: str, *by: str) -> DataFrame:
    """Per group (``by``): do equal ids form one block each?  True for an empty group."""
    change = F.col(id_col) != F.lag(id_col).over(Window.partitionBy(*by).orderBy(pos))
    blocks = df.withColumn("__new", F.coalesce(change, F.lit(True)).cast("int"))
    return blocks.groupBy(*by).agg((F.sum("__new") == F.countDistinct(id_col)).alias("contiguous"))


def clip_ranges(rng: DataFrame, low: int, high: int) -> DataFrame:
    """Ranges (idx, start, stop) that overlap [low, high], cut to it."""
    hit = rng.where((F.col("stop") >= low) & (F.col("start") <= high))
    return hit.select("idx", F.greatest("start", F.lit(low)).alias("start"), F.least("stop", F.lit(high)).alias("stop"))


def shift_ranges(rng: DataFrame, by: int) -> DataFrame:
    return rng.withColumn("start", F.col("start") + by).withColumn("stop", F.col("stop") + by)


def block_layout(df: DataFrame, label: str, pos: str) -> DataFrame:
    """First, last and middle position of each label and an alternating flag."""
    g = df.groupBy(label).agg(F.min(pos).alias("first"), F.max(pos).alias("last"))
    return g.withColumn("mid", (F.col("first") + F.col("last")) / 2).withColumn("odd", ((F.row_number().over(Window.orderBy("first")) - 1) % 2).cast("int"))


def _by_score(df: DataFrame, by: tuple[str, ...], score: str, truth: str) -> DataFrame:
    """One row per distinct score with positives and rows at or above it; ties share a threshold."""
    g = df.groupBy(*by, score).agg(F.sum(F.col(truth).cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return g.withColumn("tp", F.sum("p").over(w)).withColumn("at", F.sum("n").over(w)).withColumn("pos", F.sum("p").over(whole)).withColumn("all", F.sum("n").over(whole))


def pr_curve(df: DataFrame, score: str, truth: str, *by: str) -> DataFrame:
    c = _by_score(df, by, score, truth)
    return c.select(*by, score, (F.col("tp") / F.col("at")).alias("precision"), F.try_divide("tp", "pos").alias("recall"))


def average_precision(df: DataFrame, score: str, truth: str, *by: str) -> DataFrame:
    """Sum of precision times the gain in recall over distinct scores; NULL without positives."""
    c = _by_score(df, by, score, truth)
    return c.groupBy(*by).agg(F.sum(F.col("tp") / F.col("at") * F.try_divide("p", "pos")).alias("ap"))


def roc_curve(df: DataFrame, score: str, truth: str, *by: str) -> DataFrame:
    c = _by_score(df, by, score, truth)
    return c.select(*by, score, F.try_divide(F.col("at") - F.col("tp"), F.col("all") - F.col("pos")).alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def roc_auc(df: DataFrame, score: str, truth: str, *by: str) -> DataFrame:
    """Area by average ranks; 0.5 where only one class occurs."""
    c = _by_score(df, by, score, truth)
    neg = F.col("n") - F.col("p")
    # positives at this score beat the negatives below it and half of those beside it
    below = (F.col("all") - F.col("pos")) - (F.col("at") - F.col("tp"))
    wins = F.sum(F.col("p") * (below + neg / 2))
    pairs = F.max("pos") * (F.max("all") - F.max("pos"))
    return c.groupBy(*by).agg(F.coalesce(F.try_divide(wins, pairs), F.lit(0.5)).alias("auc"))


def trapezoid(curve: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Area under (x, y) points, sorted by x."""
    w = Window.partitionBy(*by).orderBy(x, y)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.withColumn("__step", step).groupBy(*by).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("area"))


def elbow(df: DataFrame, k: str, value: str, *by: str, least: int = 1) -> DataFrame:
    """Number of components at the largest second difference of ``value``; ties to the first, at least ``least``."""
    w = Window.partitionBy(*by).orderBy(k)
    bend = F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)
    n = F.row_number().over(w)
    d = df.withColumn("__bend", bend).withColumn("__n", n).where("__bend is not null")
    best = d.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__bend").desc(), "__n"))).where("__r = 1")
    return best.select(*by, F.greatest(F.col("__n"), F.lit(least)).alias("components"))


def block_offsets(blocks: DataFrame, order: str, size: str) -> DataFrame:
    """Start of each block when blocks follow each other."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def proportional_allocation(shares: list[float], k: int) -> list[int]:
    """Components per block: round(k * share), half to even, while any are left."""
    out, left = [], k
    for s in shares:
        out.append(min(left, round(k * s)))
        left -= out[-1]
    return out


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Code of each label: its place among the sorted distinct labels."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)


def interpret_report(scores: DataFrame) -> DataFrame:
    """Sets with a positive score per factor and view, best first; repeated keys are blank.  scores: k, view, set_name, score."""
    pos = scores.where("score > 0")
    in_k = Window.partitionBy("k").orderBy("view", F.col("score").desc(), "set_name")
    in_view = Window.partitionBy("k", "view").orderBy(F.col("score").desc(), "set_name")
    out = pos.withColumn("pos", F.row_number().over(in_k)).withColumn("in_view", F.row_number().over(in_view))
    return out.select(
        "k", "pos", F.when(F.col("pos") == 1, F.concat(F.lit("Factor "), F.col("k").cast("string"))).otherwise("").alias("factor"), F.when(F.col("in_view") == 1, F.col("view")).otherwise("").alias("view"), "set_name", "score"
    )


def factor_order(y: DataFrame) -> DataFrame:
    """(k, new_k): factors by decreasing sum of squares, ties by k."""
    ssq = y.groupBy("k").agg(F.sum(F.col("v") ** 2).alias("ssq"))
    return ssq.select("k", (F.row_number().over(Window.orderBy(F.col("ssq").desc(), "k")) - 1).alias("new_k"))


def history_segments(history: DataFrame, order: str, name: str, start: str, member: str) -> DataFrame:
    """History rows with the number of the fit they belong to.

    A fit opens at an item whose name begins with ``start`` and lasts while names
    begin with ``member``; other rows belong to none.  Rows are ranged by
    ``order``; a bucket takes the number of fits and the last change before it.
    """
    opens = F.col(name).startswith(start)
    change = F.when(opens | ~F.col(name).startswith(member), opens)
    held = buckets(history.withColumn("__opens", opens.cast("int")).withColumn("__change", change), order)
    upto = Window.partitionBy(BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    per = held.groupBy(BUCKET).agg(F.sum("__opens").alias("n"), F.max_by("__change", F.when(F.col("__change").isNotNull(), F.col(order))).alias("last"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    per = per.select(BUCKET, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.last("last", ignorenulls=True).over(before).alias("__carried"))
    marked = held.join(per, BUCKET).withColumn("fit", F.col("__before") + F.sum("__opens").over(upto))
    inside = F.coalesce(F.last("__change", ignorenulls=True).over(upto), F.col("__carried"), F.lit(False))
    return marked.withColumn("__inside", inside).where("__inside").select(*history.columns, "fit")
