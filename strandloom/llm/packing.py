"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences and then into pieces whose
lengths are the powers of two in the binary form of the rest, longest first.
Pieces of equal length form a bucket and every piece is a sequence of its own:
no sequence crosses documents and none needs padding.  Sequence ids are dense
inside a bucket and buckets follow each other by length, so a batch is a range
of ids of one length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import row_id, save, shuffle_partitions

SEQUENCE = 4096
END_ID = 2
CACHE_WORDS = 400_000
CHUNK_ROWS = 1 << 18
_GAP = re.compile(r"[ \t\n\r]+")
_PLAIN = re.compile("[ \\t\\n\\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \\t\\n\\ra-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
# the byte-level alphabet: bytes without a visible sign in Latin-1 are written as U+0100 and up, in order
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(_HIDDEN)}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class WordTokens(dict):
    """Token ids (little-endian unsigned 32-bit) of the runs that a tokenizer merges by themselves.

    The tokenizer drops white space and splits the rest into letters, single
    digits and other signs.  Texts of ASCII and Latin-1 signs are split here in
    the same way and each run goes through byte-pair merging once; the table is
    emptied when full.  Texts with other signs, an apostrophe (contractions) or
    the start of a special token go word by word, and such words through the
    whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        signs = run if run.isascii() else run.encode("utf-8").decode("latin-1").translate(_BYTE_SIGNS)
        of = self.bytes
        out = b"".join([of[t.id] for t in self.merge(signs)])
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(run) < 100:
            self[run] = out
        return out

    def _whole(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            of = self.bytes
            out = b"".join([of[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
            if len(self.words) >= CACHE_WORDS // 4:
                self.words.clear()
            if len(word) < 100:
                self.words[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if _plain(text):
            return b"".join(map(self.__getitem__, _RUNS.findall(text.lower())))
        return b"".join([b"".join(map(self.__getitem__, _RUNS.findall(w.lower()))) if _plain(w) else self._whole(w) for w in _GAP.split(text)])


def _plain(text: str) -> bool:
    return "'" not in text and "<|" not in text and _PLAIN.fullmatch(text) is not None


def word_tokens(path: str) -> WordTokens:
    """One per Python worker and path: a worker keeps its tables from task to task."""
    import sys

    tables = sys.__dict__.setdefault("_strandloom_word_tokens", {})
    if path not in tables:
        tables[path] = WordTokens(path)
    return tables[path]


def piece_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """Full sequences, then the binary form of the rest; ``most`` is a power of two."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if (n % most) >> k & 1]


def _pieces(path: str, end_id: int, most: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        end = end_id.to_bytes(4, "little")
        names = ["row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
        types = [pa.int64()] * 6 + [pa.binary()] * keep_ids
        for b in batches:
            out: list[list] = [[] for _ in names]
            for rid, doc, text in zip(b.column("row_id").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = words.ids(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                for length in piece_lengths(n, most):
                    piece = ids[4 * at : 4 * (at + length)]
                    for col, v in zip(out, (rid, doc, at, length, zlib.crc32(piece), n, piece), strict=False):
                        col.append(v)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return run


def pack_pow2(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, most: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """One row per piece: row_id, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null and empty texts are one piece of the end id alone.  A text of any length
    is cut into as many pieces as it needs.  Rows that repeat a doc_id are packed
    each.  With ``keep_ids`` the token ids come as binary.
    Only doc_id and text are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    src = docs.select(row_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    pieces = save(src.mapInArrow(_pieces(tokenizer or default_tokenizer(), end_id, most, keep_ids), schema), "pack-pieces")
    chunks = max(4 * shuffle_partitions(spark), -(-pieces.count() // CHUNK_ROWS))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(chunks)))
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    total, base = 0, []
    for length, n in sorted(tuple(r) for r in counts.groupBy("length").agg(F.sum("n")).collect()):  # a row for each power of two
        base += [F.lit(length), F.lit(total)]
        total += n
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.create_map(*base)[F.col("length")] if base else F.lit(0))
    placed = pieces.join(counts.select("length", "chunk", first.alias("first")), ["length", "chunk"])
    inside = Window.partitionBy("length", "chunk").orderBy("row_id", "start")
    out = placed.withColumn("sequence_id", (F.col("first") + F.row_number().over(inside) - 1).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
