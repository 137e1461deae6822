"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.scratch import discard, save, save_parts, shared_dir

__all__ = ["WORD", "discard", "documents", "fresh", "heavy_join", "identified", "row_id", "rows_among", "save", "save_parts", "shared_dir", "shuffle_partitions", "sliced", "text_of", "trimmed"]

#: Words are runs of anything but these separators (space and U+0009..U+000D).
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that a broadcast resolves before a shuffle: a fixed bound.
HEAVY_KEYS = 1024
#: Rows of a batch that Python holds as lists at once.
PART = 512
#: Bits of a row's place in its file.
_PLACE_BITS = 40


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_id(row: str | None = None) -> Column:
    """The column ``row``, or a number for each row of this one scan.

    The numbers hang on how files are split into tasks, which a lost executor
    or another setting changes: write them once with the columns they name and
    never take them again in a second scan (see :func:`identified`).
    """
    return F.col(row) if row else F.monotonically_increasing_id()


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _is_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is a folder or file of Parquet and nothing else, each file read once."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and plan.relation().location().rootPaths().size() == 1


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers its rows, the same in every scan, and that column's name.

    Rows of Parquet files are numbered by file and place in it, which no split
    of the files changes; other tables are written once with their numbers.
    """
    name = fresh("row_id", docs.columns)
    if not _is_files(docs):
        return save(docs.withColumn(name, row_id()), "identified"), name
    file, place, number = (fresh(x, [*docs.columns, name]) for x in ("file_of_row", "place_in_file", "number_of_file"))
    at = docs.metadataColumn("_metadata")
    paths = sorted(r[0] for r in docs.select(at["file_path"]).distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"{number} long, {file} string")
    rows = docs.withColumns({file: at["file_path"], place: at["row_index"]}).join(F.broadcast(files), file)
    return rows.withColumn(name, F.shiftleft(number, _PLACE_BITS).bitwiseOR(F.col(place))).drop(file, place, number), name


def rows_among(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number (column ``row``) is a row_id of ``rows``.

    Numbers count up in files and tasks, so a bit for each of them is broadcast
    and ``docs`` is not shuffled.
    """
    word, bits = (fresh(x, docs.columns) for x in ("word_of_row", "bits_of_word"))
    bit = lambda number: number.bitwiseAND(F.lit(63)).cast("int")
    words = rows.groupBy(F.shiftright("row_id", 6).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("row_id")))).alias(bits))
    words = save(words, "rows-among")
    found = docs.withColumn(word, F.shiftright(row, 6)).join(F.broadcast(words), word)
    return found.where(F.bit_get(bits, bit(F.col(row))) == 1).drop(word, bits)


def text_of(col: str = "text") -> Column:
    """The whole text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of ``rows`` rows, which bounds the lists made of one."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving free memory back at its task's end; Python workers stay and would hold it through later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return whole


def heavy_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, heavy: int = HEAVY_KEYS) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row per key) on ``key``, without its column ``weight``.

    The ``heavy`` keys of the largest ``weight`` are broadcast, so that the rows
    of a hot key are not shuffled to one task; the others meet in a shuffle.
    """
    top = save(lookup.orderBy(F.col(weight).desc(), key).limit(heavy).drop(weight), "heavy-keys")
    rest = rows.join(F.broadcast(top.select(key)), key, "left_anti").join(lookup.drop(weight), key)
    return rows.join(F.broadcast(top), key).unionByName(rest)
