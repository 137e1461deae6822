"""Substring deduplication by hashing normalised units of text.

A unit is a line, cut further after sentence ends; sentences of fewer than
``unit_words`` words are joined to the one after them on their line, so a unit
boundary depends only on the text right before it and a passage that many
documents share falls into the same units in all of them.  Long units, which
may differ around a shared passage, are also hashed by overlapping runs between
content-defined boundaries: any 50 words that two of them share hold a whole
run.  Units are normalised
(case folded, white space collapsed), hashed to 128 bits and grouped globally.
The earliest occurrence of a digest stays; the others are removed, and the
removed spans keep the offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, heavy_join, row_id, save

UNIT_WORDS = 8
#: Units of LONG words or more are also hashed by runs of RUN words or more between boundaries at most GAP words apart.
LONG, RUN, GAP = 50, 16, 10
PART = 512
_END = re.compile(r"[.!?](?=\s)|\n")
_WORD = re.compile(r"\S+")


def units(text: str, unit_words: int = UNIT_WORDS) -> Iterator[tuple[int, int]]:
    """(start, end) of the units in code points; they cover the text without gaps."""
    start = sentence = 0
    size = len(text)
    for m in _END.finditer(text):
        end = m.end()
        while end < size and text[end] != "\n" and text[end].isspace():
            end += 1
        if m[0] != "\n" and end < size and text[end] == "\n":
            continue  # the line break ends it
        if m[0] == "\n" or len(text[sentence:end].split()) >= unit_words:
            yield start, end
            start = end
        sentence = end
    if start < size:
        yield start, size


def runs(text: str, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the runs of a unit.

    Of every GAP word pairs in a row the last with the least hash starts at a
    boundary, which depends on these words only; a run goes from a boundary to
    the first one RUN or more words on, so it has at most RUN + GAP - 1 words.
    """
    at, words = zip(*((m.start(), m[0].casefold().encode("utf-8", "surrogatepass")) for m in _WORD.finditer(text, start, end)), strict=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = (h[:-1] ^ h[1:] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.lib.stride_tricks.sliding_window_view(h, GAP)[:, ::-1].argmin(axis=1)
    cuts = np.unique(np.arange(len(least)) + GAP - 1 - least)
    for i, k in zip(cuts.tolist(), np.searchsorted(cuts, cuts + RUN).tolist(), strict=True):
        if k < len(cuts):
            j = int(cuts[k])
            yield at[i], at[j], xxhash.xxh3_128_digest(b"\0" + b" ".join(words[i:j]))


def _digests(unit_words: int, least: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):  # bounds the lists
            ids, docs, starts, ends, digests = [], [], [], [], []
            for rid, doc, t in zip(b.column("row_id").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = t.as_py() or ""
                for i, j in units(text, unit_words):
                    words = text[i:j].casefold().split()
                    line = whole and words and (i == 0 or text[i - 1] == "\n") and (j == len(text) or text[j - 1] == "\n")
                    if len(words) >= least or line:
                        ids.append(rid)
                        docs.append(doc)
                        starts.append(i)
                        ends.append(j)
                        digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                    if whole and len(words) >= LONG:
                        for a, z, digest in runs(text, i, j):
                            ids.append(rid)
                            docs.append(doc)
                            starts.append(a)
                            ends.append(z)
                            digests.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())], ["row_id", "doc_id", "i", "j", "digest"])

    return run


def repeated_spans(src: DataFrame, unit_words: int = UNIT_WORDS, least: int = UNIT_WORDS, whole: bool = False) -> DataFrame:
    """row_id and spans (array of struct i, j; by i): the units to remove from each row of ``src`` (row_id, doc_id, text) that has any.

    Units of fewer than ``least`` words always stay, unless ``whole`` is set and
    they are a line; with it the runs of long units count too, and spans may overlap.  Earliest is by doc_id
    (nulls last), then row_id, then offset.  A digest's earliest occurrence is a
    partial aggregate; the commonest digests find it by a broadcast.
    """
    found = save(src.mapInArrow(_digests(unit_words, least, whole), "row_id long, doc_id long, i long, j long, digest binary"), "substring-units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id", "i")
    groups = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("keep")).where("n > 1")
    groups = save(groups.select("digest", "n", F.col("keep.row_id").alias("keep_row"), F.col("keep.i").alias("keep_i")), "substring-groups")
    gone = heavy_join(found, groups, "digest", "n").where((F.col("row_id") != F.col("keep_row")) | (F.col("i") != F.col("keep_i")))
    spans = save(gone.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("spans")), "substring-spans")
    discard(found, groups)
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
        kept, merged = [], []
        for t, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            text, at, parts = t.as_py() or "", 0, []
            own = None if spans is None else []
            for s in spans or ():
                if own and s["i"] < at:
                    own[-1]["j"] = at = max(at, s["j"])
                    continue
                parts.append(text[at : s["i"]])
                own.append(s)
                at = s["j"]
            kept.append("".join([*parts, text[at:]]))
            merged.append(own)
        yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(merged, b.column("spans").type), pa.array(kept, pa.string())], ["row_id", "doc_id", "spans", "kept_text"])


def substring_dedup(docs: DataFrame, unit_words: int = UNIT_WORDS, least: int = UNIT_WORDS, whole: bool = False) -> DataFrame:
    """One row per document: row_id, doc_id, spans (removed, original offsets; null if none), kept_text.

    With ``whole`` lines of any length and the runs of long units count too;
    overlapping spans are joined.  Null texts count as empty and keep the empty text.  Of equal rows the one
    with the smallest row_id keeps its units.  A text of any length is read whole
    by one task.  The rows are written once with their row_id.  Other columns are
    not read; an empty table gives no rows.
    """
    src = save(docs.select(row_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "substring-rows")
    spans = repeated_spans(src, unit_words, least, whole)
    return src.join(spans, "row_id", "left").mapInArrow(_cut, "row_id long, doc_id long, spans array<struct<i:long,j:long>>, kept_text string")
