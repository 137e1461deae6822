"""Mixing sources to target weights.

The words of a source, document after document, are cut into blocks of a fixed
length.  Output shards draw how many slots each source gets from a multinomial
with the target shares; a source that has its share drops out and what the
draws left open fills the last shards, so every source gets its slots exactly.
The j-th slot of a source takes block  permutation[epoch](j mod blocks)  with
epoch = j div blocks, a keyed Feistel permutation of the block indices.  Slots
and blocks meet in an equi-join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, fresh, row_id, save, shuffle_partitions, sliced, text_of, trimmed

BLOCK_WORDS = 128
SHARD_SLOTS = 1 << 18
MOST_SHARDS = 1 << 16
RUN_SLOTS = 4096
CHUNK_ROWS = 4096
LEAST_CHUNKS = 64


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Share ``share`` of all sizes by weight; nobody above ``most`` times its size.

    What is cut off is shared by weight among the rest until none is above.
    """
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def shard_counts(slots: list[int], shard_slots: int, seed: int) -> np.ndarray:
    """Slots of each source (column) in each output shard (row); columns sum to ``slots``."""
    want = np.array(slots, np.int64)
    total = int(want.sum())
    if not total:
        return np.zeros((0, len(slots)), np.int64)
    rng = np.random.default_rng(seed)
    shards = -(-total // shard_slots)
    draws = rng.multinomial([min(shard_slots, total - i * shard_slots) for i in range(shards)], want / total)
    placed = np.diff(np.minimum(np.cumsum(draws, axis=0), want), axis=0, prepend=0)
    left = want - placed.sum(axis=0)
    room = np.array([min(shard_slots, total - i * shard_slots) for i in range(shards)]) - placed.sum(axis=1)
    for i in np.flatnonzero(room):  # what draws beyond a source's share left open
        p = left / left.sum()
        draw = np.minimum(rng.multinomial(room[i], p), left)
        for s in np.argsort(-(left - draw), kind="stable"):
            draw[s] += min(left[s] - draw[s], room[i] - draw.sum())
        placed[i] += draw
        left -= draw
    return placed


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to j, element by element (Feistel, cycle walking)."""
    with np.errstate(over="ignore"):
        half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)
        x, todo = j.astype(np.uint64).copy(), np.ones(len(j), bool)
        while todo.any():
            left, right = x[todo] >> half[todo], x[todo] & mask[todo]
            for r in range(4):
                h = right * np.uint64(0x9E3779B97F4A7C15) + key[todo].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(r + 1) * np.uint64(0x165667B19E3779F9)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                left, right = right, left ^ (h & mask[todo])
            x[todo] = (left << half[todo]) | right
            todo &= x >= n.astype(np.uint64)
        return x.astype(np.int64)


@dataclass
class Mix:
    """sizes: row_id, doc_id, source, s, size, at; sources: s, source, source_size, target; pieces: see :func:`mix_sources`."""

    sizes: DataFrame
    sources: DataFrame
    pieces: DataFrame


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 1,
    row: str | None = None,
) -> Mix:
    """Plan a mix of ``docs`` (doc_id, source, text; other columns are not read).

    ``pieces`` has a row for each stretch of words that a slot takes from a
    document: shard, slot, epoch, row_id, doc_id, start, n (words).  The driver
    holds one row for each source and one count for each (output shard,
    source); shards grow beyond ``shard_slots`` where there would be more than
    ``MOST_SHARDS``, so these counts are bounded by the number of sources alone.
    Slots are made on the executors.  ``row`` names a column that numbers the
    rows (default: numbers are given here).

    Null texts have size 0, sources that are null form a source of their own,
    last in order.  Sources without words and documents without words take no
    part.  Rows that repeat a doc_id are documents of their own.  A very long
    text is cut into blocks like any other.  The order of words in a source is
    that of ids and texts, so runs agree however the table's files are split;
    rows alike in both may change places.  An empty table gives empty results.
    """
    spark = docs.sparkSession
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    sized = save(docs.select(row_id(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text_of()).alias("content")), "mix-sizes")
    per = sorted(((r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in per]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], share, most)
    blocks = [-(-n // block_words) for n in sizes]
    # the last slot of a source takes only the words that its target still needs
    slots, last = [], []
    for n, t, b in zip(sizes, want, blocks, strict=True):
        full = most * b if n and t >= most * n - 1e-6 else int(t * b / n) if n else 0
        rest = round(t - full * n / b) if n and full < most * b else 0
        slots.append(full + (rest > 0))
        last.append(rest or block_words)
    sources = spark.createDataFrame([(i, s, n, float(t)) for i, ((s, n), t) in enumerate(zip(per, want, strict=True))], "s int, source string, source_size long, target double")

    # place of each document in its source: sums of hashed chunks, then inside a chunk; ids and texts alone decide
    chunks = max(LEAST_CHUNKS, -(-sized.count() // CHUNK_ROWS))
    named = sized.join(sources.select("s", F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    named = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "content"), F.lit(chunks)))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = named.groupBy("s", "chunk").agg(F.sum("size").alias("n")).select("s", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "chunk").orderBy("doc_id", "content", "size", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["s", "chunk"]).withColumn("at", F.col("at") + F.col("base"))
    placed = save(placed.select("row_id", "doc_id", "source", "s", "size", "at"), "mix-placed")
    first, final = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    held = placed.where("size > 0").select("s", "row_id", "doc_id", "at", "size", F.explode(F.sequence(first, final)).alias("block"))

    # slots of one source in one output shard, spread over the executors by runs
    counts = shard_counts(slots, max(shard_slots, -(-sum(slots) // MOST_SHARDS)), seed)
    shard, s = np.nonzero(counts)
    firsts = (np.cumsum(counts, axis=0) - counts)[shard, s]
    drawn = pd.DataFrame({"shard": shard.astype(np.int32), "s": s.astype(np.int32), "first": firsts, "n": counts[shard, s]})
    drawn = spark.createDataFrame(drawn, "shard int, s int, first long, n long")
    run = drawn.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN_SLOTS).cast("long")))).repartition(shuffle_partitions(spark), "shard", "s", "at")
    slot = run.select("shard", "s", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + RUN_SLOTS, "n") - 1)).alias("j"))

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_blocks, n_slots, cut = np.array(blocks or [0], np.int64), np.array(slots or [0], np.int64), np.array(last or [0], np.int64)
        for pdf in batches:
            s, j = pdf["s"].to_numpy(), pdf["j"].to_numpy()
            n = np.maximum(n_blocks[s], 1)
            epoch = j // n
            block = permute(j % n, n, s * 1000003 + epoch + seed * 7919)
            limit = np.where(j == n_slots[s] - 1, cut[s], block_words)
            yield pd.DataFrame({"shard": pdf["shard"], "s": s, "slot": j, "epoch": epoch, "block": block, "limit": limit})

    slot = slot.mapInPandas(to_blocks, "shard int, s int, slot long, epoch long, block long, limit long")
    low = F.greatest(F.col("at"), F.col("block") * block_words)
    high = F.least(F.col("at") + F.col("size"), F.col("block") * block_words + F.col("limit"))
    # no size estimate follows an explode: never broadcast a side
    pieces = slot.join(held.hint("shuffle_merge"), ["s", "block"]).select("shard", "slot", "epoch", "row_id", "doc_id", (low - F.col("at")).alias("start"), (high - low).alias("n")).where("n > 0")
    return Mix(placed, sources, pieces)


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: row_id, doc_id, size, source_size, target, taken, passes."""
    taken = mix.pieces.groupBy("row_id").agg(F.sum("n").alias("taken"), F.countDistinct("epoch").alias("passes"))
    return (
        mix.sizes.join(mix.sources.drop("source"), "s")
        .join(taken, "row_id", "left")
        .select("row_id", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("passes", F.lit(0)).alias("passes"))
    )


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The stretches of ``text`` from word ``start`` to word ``end`` (exclusive), white space inside kept."""
    import re

    at = [m.span() for m in re.finditer(WORD, text)]
    if runs == [(0, len(at))]:
        return text
    return "\n".join(text[at[i][0] : at[j - 1][1]] for i, j in runs)


def mixed_documents(docs: DataFrame, mix: Mix, row: str) -> DataFrame:
    """``docs``' columns; a row for each pass over a document with the words the mix takes in it.

    ``row`` is the column that numbered the rows for :func:`mix_sources`; it is
    dropped.  Texts (and n_chars, if there) change where a pass doesn't take all
    words.  The words of a pass stay in their document, whatever shards took
    them: the mix's order is that of ``pieces``, not of these rows.
    """
    kept = [c for c in docs.columns if c != row]
    held = fresh("stretches", docs.columns)
    taken = mix.pieces.groupBy("row_id", "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias(held))
    rows = docs.join(taken.select(F.col("row_id").alias(row), held), row).select(*kept, held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = []
            for text, stretches in zip(b.column("text"), b.column(held).to_pylist(), strict=True):
                runs: list[tuple[int, int]] = []
                for x in stretches:
                    if runs and runs[-1][1] == x["start"]:
                        runs[-1] = (runs[-1][0], x["start"] + x["n"])
                    else:
                        runs.append((x["start"], x["start"] + x["n"]))
                texts.append(cut_words(text.as_py(), runs))
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), b.schema.field("n_chars").type if "n_chars" in kept else pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in kept], kept)

    return rows.mapInArrow(trimmed(cut), docs.select(*kept).schema)
