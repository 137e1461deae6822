"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1.  Every text is reduced to its SHA-256; the digests are written once.
2.  Misra-Gries finds frequent digests.  Blocks of rows are counted exactly and
    pruned to ``counters`` counters by subtracting the (counters+1)-th largest
    count from all; that is the prune step of mergeable Misra-Gries summaries.
    The summaries are added up by digest and the largest ``counters`` sums are
    the candidates.  A digest on more than 1/(counters+1) of the rows of the
    table has a positive sum in the end.
3.  Exact counts and winners of the candidates ("verified winners", at most
    ``counters`` rows, so the broadcast has a fixed bound) resolve all rows of
    frequent digests on the map side.
4.  Only the remaining digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import row_id, save, text_of

COUNTERS = 1024
BLOCK_ROWS = 16384


def misra_gries(rows: DataFrame, key: str, counters: int = COUNTERS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """At most ``counters`` rows (key, estimate): the likely frequent keys.

    ``rows`` needs a ``row_id`` from :func:`row_id`, whose upper bits are the
    partition, so a block never holds more than ``block_rows`` rows.
    """
    block = rows.groupBy(F.floor(F.col("row_id") / block_rows).alias("block"), key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("block")
    ranked = block.withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), key)))
    floor = F.coalesce(F.max(F.when(F.col("rank") == counters + 1, F.col("n"))).over(w), F.lit(0))
    pruned = ranked.withColumn("estimate", F.col("n") - floor).where(F.col("estimate") > 0)
    merged = pruned.groupBy(key).agg(F.sum("estimate").alias("estimate"))
    return merged.orderBy(F.col("estimate").desc(), key).limit(counters)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, row: str | None = None) -> DataFrame:
    """One row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text, so null and
    empty texts form one group.  Of equal texts the row with the largest id
    stays (null ids are smallest); among rows that repeat both id and text the
    one with the largest row_id stays, so exactly one row of a group is kept.
    ``row`` names a column that numbers the rows (default: numbers are given
    here).  A text of any length is hashed whole.  Other columns of ``docs`` are
    never read.  An empty table gives no rows.
    """
    rows = save(
        docs.select(
            row_id(row).alias("row_id"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"),
        ),
        "exact-digests",
    )
    resolve = (F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("keep"))
    frequent = misra_gries(rows, "digest", counters).select("digest")
    winners = save(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*resolve), "exact-winners")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    out = rows.join(F.broadcast(winners), "digest").unionByName(light.join(light.groupBy("digest").agg(*resolve), "digest"))
    return out.select(
        "row_id",
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
