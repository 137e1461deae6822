"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A text is parsed into phrases that overlap at anchors.  An anchor is the first
minimum of a gram hash among ``REACH`` positions on both sides, so it depends on
the 96 bytes around it alone, and the anchors well inside a string of ``least``
bytes are the same wherever that string occurs.  The suffixes of the parse,
bounded to what a string can reach, are sorted once, in their shard (its suffix
array); the phrase before a suffix is its Burrows-Wheeler symbol.

The shards' transforms are merged by interleave refinement.  The interleave
starts as the shards' sorted runs one after the other.  Round d counts the
symbols at place d for each block and shard, and the counts say where each
group of suffixes goes: blocks split by the symbol, a shard's suffixes keep
their order.  No suffix is compared or sorted again.  The round at which
suffixes part is their common prefix, and the blocks of round d are the
repeated intervals of d + 1 symbols.  If two suffixes of a block also agree in
the transform's symbol and the phrase after, all strings between those phrases
are repeated.  If not, the interval is left- or right-maximal and its strings,
which end inside the differing phrases, are counted one by one by their hash.

Strings in which no anchor fits are counted by their own hash from the start.
The merge is dealt by the first symbol; a first symbol on more than ``hot_rows``
suffixes is dealt by two symbols, and so on, and what then spreads over several
tasks is counted one by one.  Symbols have 128 bits, counted strings 96.

Texts are known by a digest of their bytes, never by their place in a file, so
a scan that is run again gives the same rows; copies of a text are merged once
and are removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, save, shuffle_partitions, text_of

LEAST = 400
GRAM = 16
REACH = 40
HOT_ROWS = 65_536
SHARD_BYTES = 8 << 20
ANSWER_BYTES = 4 << 20
BUFFER = 1 << 20
SYMBOL = 16
_BROADCAST_KEYS = 1_000_000
_EDGE = GRAM + 2 * REACH
_RNG = np.random.default_rng(20240229)
_TABLES = [(_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base) for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _window_hash(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` bytes, by doubling; empty if there is none."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    table, base = _TABLES[which]
    with np.errstate(over="ignore"):
        power, have = table[data], 1
        out, done = None, 0
        while True:
            if width & have:
                # windows of ``done`` bytes, then ``have`` more
                part = power[done : done + n]
                out = part.copy() if out is None else out * np.uint64(pow(base, have, 1 << 64)) + part
                done += have
            if done == width:
                break
            power = power[:-have] * np.uint64(pow(base, have, 1 << 64)) + power[have:]
            have *= 2
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def _string_keys(text: bytes, ranges: list[tuple[int, int]], least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """96-bit keys, as 64 and 32 bits, of the strings that start in each inclusive range."""
    parts = [np.frombuffer(text[i : j + least], np.uint8) for i, j in ranges]
    return [_window_hash(p, least) for p in parts], [(_window_hash(p, least, 1) >> np.uint64(32)).astype(np.uint32) for p in parts]


def _anchors(data: np.ndarray) -> np.ndarray:
    """Positions of the anchors of one buffer."""
    h = (_window_hash(data, GRAM) >> np.uint64(32)).astype(np.uint32)
    if len(h) <= 2 * REACH:
        return np.zeros(0, np.int64)
    low, have = h, 1
    while have * 2 <= REACH:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[: len(h) - REACH + 1], low[REACH - have : len(h) - have + 1])
    mid = h[REACH : len(h) - REACH]
    return np.flatnonzero((mid < low[: len(mid)]) & (mid <= low[REACH + 1 :][: len(mid)])) + REACH


def parse(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Anchors of each text; short texts share a buffer."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BUFFER):
            size += len(texts[to])
            to += 1
        group = texts[at:to]
        ends = np.cumsum([len(t) for t in group])
        pos = _anchors(np.frombuffer(b"".join(group), np.uint8))
        owner = np.searchsorted(ends, pos, "right")
        first = (ends - [len(t) for t in group])[owner] if len(pos) else pos
        inside = (pos - REACH >= first) & (pos + GRAM + REACH <= ends[owner]) if len(pos) else np.zeros(0, bool)
        pos, owner = (pos - first)[inside], owner[inside]
        cut = np.searchsorted(owner, np.arange(len(group) + 1))
        for k in range(len(group)):
            yield pos[cut[k] : cut[k + 1]]
        at = to


def _trigger(text: bytes, a: int) -> bytes:
    return xxhash.xxh3_128_digest(text[a - REACH : a + GRAM + REACH])


def _key_of(symbol: bytes) -> int:
    return int.from_bytes(symbol[:8], "little")


def bare_windows(n: int, anchors: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Inclusive ranges of starts of the strings without an anchor well inside."""
    out, p = [], 0
    for a in anchors.tolist():
        # strings from p on see this anchor if they start in a + GRAM + REACH - least .. a - REACH
        stop = a + GRAM + REACH - least - 1
        if stop >= p:
            out.append((p, min(stop, n - least)))
        p = max(p, a - REACH + 1)
    if p <= n - least:
        out.append((p, n - least))
    return [(i, j) for i, j in out if i <= j]


def windows(n: int, anchors: list[int], f: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(d, low, high): starts of the strings whose anchors well inside are f .. f + d."""
    low = anchors[f - 1] - REACH + 1 if f else 0
    high = min(anchors[f] - REACH, n - least)
    for d in range(len(anchors) - f):
        i = max(low, anchors[f + d] + GRAM + REACH - least)
        if i > high:
            return
        j = min(high, anchors[f + d + 1] + GRAM + REACH - least - 1) if f + d + 1 < len(anchors) else high
        if i <= j:
            yield d, i, j


def _bare_key(h: np.ndarray) -> np.ndarray:
    return h ^ np.uint64(0xA5A5A5A5A5A5A5A5)


def _first_symbols(least: int):
    """(dkey, key, more, n): first symbols of suffixes and strings without an anchor, with their number in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = b.column("text").slice(at, 256).to_pylist()
                rows, keys, more, counts = [], [], [], []
                for dkey, text, anchors in zip(b.column("dkey").slice(at, 256).to_pylist(), texts, parse(texts), strict=True):
                    symbols = np.frombuffer(b"".join([_trigger(text, a) for a in anchors.tolist()]), np.uint64).reshape(-1, 2)
                    wide, small = _string_keys(text, bare_windows(len(text), anchors, least), least)
                    key = np.concatenate([symbols[:, 0], *map(_bare_key, wide)])
                    tail = np.concatenate([(symbols[:, 1] >> np.uint64(32)).astype(np.uint32), *small])
                    k, where, n = np.unique(key, return_index=True, return_counts=True)
                    keys.append(k)
                    more.append(tail[where])
                    counts.append(n)
                    rows += [dkey] * len(k)
                if rows:
                    columns = [np.concatenate(keys).view(np.int64), np.concatenate(more).view(np.int32), np.concatenate(counts).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *map(pa.array, columns)], ["dkey", "key", "more", "n"])

    return run


def suffixes(text: bytes, anchors: np.ndarray, known: set[int], least: int) -> Iterator[tuple[int, tuple[bytes, ...], bytes, int]]:
    """(f, symbols, symbol before, valid depths as bits) of the bounded suffixes of the parse whose symbols are repeated."""
    a, n = anchors.tolist(), len(text)
    trig = [_trigger(text, x) for x in a]
    good = [_key_of(t) in known for t in trig]
    phrase: dict[int, bytes] = {}

    def between(t: int) -> bytes:
        if t not in phrase:
            i = 0 if t < 0 else a[t] - REACH
            j = n if t + 1 >= len(a) else a[t + 1] + GRAM + REACH
            phrase[t] = xxhash.xxh3_128_digest(bytes([(t < 0) | (t + 1 >= len(a)) << 1]) + text[i:j])
        return phrase[t]

    for f in range(len(a)):
        if not good[f]:
            continue
        bits, top = 0, -1
        for d, _, _ in windows(n, a, f, least):
            if not all(good[f : f + d + 1]):
                break
            bits |= 1 << d
            top = d
        if bits:
            yield f, (trig[f], *(between(f + d) for d in range(top + 1))), between(f - 1), bits


_SUFFIX = "kind int, dkey binary, f int, settled int, emit int, shard long, syms binary, prev binary, bits int, n long"
_SUFFIX_TYPES = dict(kind=pa.int32(), dkey=pa.binary(), f=pa.int32(), settled=pa.int32(), emit=pa.int32(), shard=pa.int64(), syms=pa.binary(), prev=pa.binary(), bits=pa.int32(), n=pa.int64())


def _sorted_suffixes(least: int):
    """Suffix array and transform of each shard, a run of equal suffixes as one row with its count.

    kind 0: verdicts (the other rows of a run; all their strings are repeated);
    kind 1: rows to merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, b in enumerate(batches):
            rows: list[tuple] = []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column("text").to_pylist()
                for dkey, text, anchors, known in zip(part.column("dkey").to_pylist(), texts, parse(texts), part.column("keys").to_pylist(), strict=True):
                    known = {k & (1 << 64) - 1 for k in known}
                    rows += [(s, prev, bits, dkey, f) for f, s, prev, bits in suffixes(text, anchors, known, least)]
            rows.sort()
            out: dict[str, list] = {k: [] for k in _SUFFIX_TYPES}
            first = None
            for s, prev, bits, dkey, f in rows:
                if first is not None and first[:3] == (s, prev, bits):
                    out["n"][first[3]] += 1
                    row = dict(kind=0, dkey=dkey, f=f, settled=bits)
                else:
                    first = (s, prev, bits, len(out["n"]))
                    row = dict(kind=1, dkey=dkey, f=f, shard=shard, syms=b"".join(s), prev=prev, bits=bits, n=1)
                for k, v in out.items():
                    v.append(row.get(k, b"" if k in ("syms", "prev") else 0))
            yield pa.RecordBatch.from_arrays([pa.array(v, _SUFFIX_TYPES[k]) for k, v in out.items()], list(out))

    return run


def _differ(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        edge = c[1:] != c[:-1]
        out[1:] |= edge.any(axis=1) if edge.ndim > 1 else edge
    return out


def _refine(order: np.ndarray, block: np.ndarray, shard: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split every block of the interleave by ``symbol``; the new interleave and its blocks.

    In a block the suffixes of a shard are in their sorted order, so equal
    symbols are neighbours.  These groups are counted, the counts give each
    group its place, and every suffix goes to its group's place in the order it
    had.
    """
    own = symbol[order]
    first = _differ(block, shard[order], own)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(order)))
    by = np.lexsort((own[start, 1], own[start, 0], block[start]))  # of the counted groups, not of suffixes
    to = np.empty(len(start), np.int64)
    to[by] = np.cumsum(size[by]) - size[by]
    group = np.cumsum(first) - 1
    at = to[group] + np.arange(len(order)) - start[group]
    out, blocks = np.empty_like(order), np.empty_like(block)
    out[at] = order
    blocks[at] = block
    return out, np.cumsum(_differ(blocks, symbol[out])) - 1


def merge_runs(syms: list[bytes], shard: np.ndarray, prev: np.ndarray, bits: np.ndarray, n: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(settled, emit) depth bits of the suffixes of several shards, by interleave refinement.

    Suffixes come by shard, sorted by their symbols in it.  settled: all strings
    of that depth are repeated; emit: they have to be counted one by one (for a
    settled one, as the others' counterpart).  A suffix that was dealt by its
    first ``level`` symbols may have partners of fewer common ones elsewhere.
    ``prev``: symbols before, as two 64-bit columns.
    """
    m = len(syms)
    depth = np.array([len(s) // SYMBOL - 1 for s in syms], np.int64)
    width = int(depth.max(initial=0))
    table = np.zeros((m, width + 1, 2), np.uint64)
    for i, s in enumerate(syms):
        table[i, : depth[i] + 1] = np.frombuffer(s, np.uint64).reshape(-1, 2)
    settled = np.where(n > 1, bits, 0)
    emit = bits & ((1 << (level - 1)) - 1)
    order, block = np.arange(m), np.zeros(m, np.int64)
    for d in range(width):
        ok = depth[order] > d  # suffixes that are too short leave
        order, block = order[ok], block[ok]
        if not len(order):
            break
        order, block = _refine(order, block, shard, table[:, d])
        size = np.bincount(block)
        more = (size[block] > 1) | (n[order] > 1)
        order, block = order[more], block[more]
        # strings of depth d: first d + 1 symbols equal; the context is the symbol before and the next
        has = (bits[order] >> d) & 1 == 1
        own, blk = order[has], block[has]
        if not len(own):
            continue
        nxt, before = table[own, d + 1], prev[own]
        by = np.lexsort((nxt[:, 1], nxt[:, 0], before[:, 1], before[:, 0], blk))  # contexts, to be counted
        own, blk, nxt, before = own[by], blk[by], nxt[by], before[by]
        start = _differ(blk, before, nxt)
        context = np.cumsum(start) - 1
        several = np.bincount(context) > 1
        settled[own[several[context]]] |= 1 << d
        first = np.flatnonzero(_differ(blk))
        open_ = np.repeat(np.add.reduceat(start.astype(np.int64), first), np.diff(np.append(first, len(own)))) > 1
        rep = start | ((settled[own] >> d) & 1 == 0)
        emit[own[open_ & rep]] |= 1 << d
    return settled, emit


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, shard and symbols; one bucket is held at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        shard, bits, n, level, f = (t.column(c).to_numpy() for c in ("shard", "bits", "n", "level", "f"))
        prev = np.frombuffer(b"".join(t.column("prev").to_pylist()), np.uint64).reshape(-1, 2)
        settled, emit = merge_runs(t.column("syms").to_pylist(), shard, prev, bits.astype(np.int64), n, level.astype(np.int64))
        some = np.flatnonzero(settled | emit)
        return pa.RecordBatch.from_arrays([t.column("dkey").take(pa.array(some)).combine_chunks(), *(pa.array(v[some].astype(np.int32)) for v in (f, settled, emit))], ["dkey", "f", "settled", "emit"])

    for b in batches:
        bucket = b.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and i < b.num_rows and held[-1].column("bucket")[0].as_py() != bucket[i]:
                yield flush()
                held = []
            if j > i:
                held.append(b.slice(i, j - i))
    if held:
        yield flush()


def _dealt(runs: DataFrame, hot_rows: int) -> DataFrame:
    """``runs`` with bucket and level: by as many first symbols as keep a bucket's prefix to ``hot_rows`` rows.

    Where all symbols don't suffice, the symbol before joins them.
    """
    has = (F.octet_length("syms") / SYMBOL).cast("int")
    prefix = lambda n: F.xxhash64(F.substring("syms", 1, SYMBOL * n))
    out = runs.withColumn("key", prefix(1)).withColumn("level", F.lit(1))
    deepest = runs.agg(F.max(has)).first()[0] or 0
    for n in range(1, deepest + 1):
        hot = out.where(F.col("level") == n).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows).select("key", F.lit(True).alias("is_hot"))
        hot = save(hot, "suffix-hot")
        found = hot.count()
        if not found:
            break
        hot = F.broadcast(hot) if found <= _BROADCAST_KEYS else hot
        deeper = F.when(has > n, prefix(n + 1)).otherwise(F.xxhash64("syms", "prev"))
        out = out.join(hot, "key", "left").withColumn("level", F.when(F.col("is_hot"), n + 1).otherwise(F.col("level"))).withColumn("key", F.when(F.col("is_hot"), deeper).otherwise(F.col("key"))).drop("is_hot")
    return out


def _open_windows(text: bytes, anchors: np.ndarray, verdicts: list[tuple[int, int, int]], least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of starts of strings: repeated for sure, and to be counted one by one."""
    a, n = anchors.tolist(), len(text)
    sure, count = [], []
    for f, settled, emit in verdicts:
        for d, i, j in windows(n, a, f, least):
            if settled >> d & 1:
                sure.append((i, j))
            if emit >> d & 1:
                count.append((i, j))
    return sure, count


def _counted(pdf: pd.DataFrame, least: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Per row what :func:`_open_windows` gives, and the keys of all strings to be counted, in order."""
    rows = pdf.sort_values("dkey").to_dict("records")
    texts = [bytes(r["text"]) for r in rows]
    info, wide, small = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for r, text, anchors in zip(rows, texts, parse(texts), strict=True):
        verdicts = sorted((v["f"], v["settled"], v["emit"]) for v in (r["verdicts"] if r["verdicts"] is not None else ()))
        sure, count = _open_windows(text, anchors, verdicts, least)
        own = _string_keys(text, count, least)
        wide += own[0]
        small += own[1]
        info.append((r, text, anchors, sure, count))
    return info, np.concatenate(wide), np.concatenate(small)


def distinct_keys(wide: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (wide, small), sorted, their counts, and the place of each input among them."""
    order = np.argsort(wide)
    if (_differ(small[order]) & ~_differ(wide[order])).any():  # equal in 64 bits alone
        order = np.lexsort((small, wide))
    a, b = wide[order], small[order]
    first = _differ(a, b)
    start, place = np.flatnonzero(first), np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return a[start], b[start], np.diff(np.append(start, len(a))), place


def _slices(wide: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that sorted keys fall into, by range."""
    if not len(wide):
        return []
    of = ((wide >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    start = np.flatnonzero(_differ(of))
    return [(int(of[i]), int(i), int(j)) for i, j in zip(start, np.append(start[1:], len(of)), strict=True)]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _cover(text: bytes, sure: list[tuple[int, int]], starts: list[np.ndarray], least: int) -> np.ndarray:
    """Bytes covered by the strings of the ranges ``sure`` and the ``starts``."""
    edge = np.zeros(len(text) + 1, np.int32)
    for i, j in sure:
        edge[i] += 1
        edge[j + least] -= 1
    for p in starts:
        edge[p] += 1
        edge[p + least] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, least: int = LEAST, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Removes every byte covered by a string of ``least`` bytes that also starts
    anywhere else in the table, the same text included; overlaps count, matches
    never cross texts and all strings are judged on the input.  ``spans`` are
    the removed runs (byte offsets; null if none).  Null texts are empty.  Rows
    that repeat a doc_id or a text are texts of their own.  A text of any length
    is read whole and held by one task.  Only doc_id and text are read; an empty
    table gives no rows.
    """
    parts = shuffle_partitions(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").cast("binary").alias("text"))
    src = src.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("whole", F.sha2("text", 256))
    src = src.withColumn("dkey", F.unhex(F.substring("whole", 1, 32)))
    long = src.where(F.col("n_bytes") >= least).select("dkey", "text")

    # first symbols that occur twice or more, and the texts that have any
    first = save(long.mapInArrow(_first_symbols(least), "dkey binary, key long, more int, n long"), "suffix-first")
    twice = save(first.groupBy("key", "more").agg(F.sum("n").alias("total")).where("total > 1").select("key", "more"), "suffix-twice")
    hits = first.select("dkey", "key", "more").join(twice, ["key", "more"]).groupBy("dkey").agg(F.collect_set("key").alias("keys"))
    hits = save(hits, "suffix-hits")
    discard(first, twice)
    texts = long.groupBy("dkey").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    near = save(texts.join(hits, "dkey"), "suffix-near")
    discard(hits)

    # shards: sorted suffixes; merge; verdicts
    runs = save(near.mapInArrow(_sorted_suffixes(least), _SUFFIX), "suffix-runs")
    open_ = runs.where("kind = 1").select("shard", "syms", "prev", "bits", "n", "dkey", "f")
    buckets = max(parts, -(-open_.count() // hot_rows))
    dealt = _dealt(open_, hot_rows).withColumn("bucket", F.pmod("key", F.lit(buckets))).drop("key")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "shard", "syms")
    merged = dealt.mapInArrow(_merge, "dkey binary, f int, settled int, emit int")
    verdicts = merged.unionByName(runs.where("kind = 0").select("dkey", "f", "settled", "emit"))
    per_text = verdicts.groupBy("dkey").agg(F.collect_list(F.struct("f", "settled", "emit")).alias("verdicts"))
    total = near.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4 * parts, -(-total // SHARD_BYTES))
    sharded = save(near.join(per_text, "dkey", "left").withColumn("shard", F.pmod(F.xxhash64("dkey"), F.lit(shards))), "suffix-sharded")
    discard(near, runs)

    # strings at the ends of maximal repeats, counted by hash in packed rows
    ranges = max(parts, -(-total // ANSWER_BYTES))

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, wide, small = _counted(pdf, least)
        wide, small, n, _ = distinct_keys(wide, small)
        rows = [(key[0], b, wide[i:j].tobytes(), small[i:j].tobytes(), np.packbits(n[i:j] > 1).tobytes()) for b, i, j in _slices(wide, ranges)]
        return pd.DataFrame(rows, columns=["shard", "bucket", "wide", "small", "several"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = [np.frombuffer(k, np.uint64) for k in pdf["wide"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)) for s, k in zip(pdf["several"], wide, strict=True)]).astype(bool)
        _, _, n, place = distinct_keys(np.concatenate(wide), np.concatenate([np.frombuffer(k, np.uint32) for k in pdf["small"]]))
        repeated = (n[place] > 1) | several
        ends = np.cumsum([len(k) for k in wide])
        return pd.DataFrame({"shard": pdf["shard"], "bucket": key[0], "repeated": [np.packbits(x).tobytes() for x in np.split(repeated, ends[:-1])]})

    asked = sharded.where(F.exists("verdicts", lambda v: v["emit"] > 0)).select("shard", "dkey", "text", "verdicts")
    sent = save(asked.groupBy("shard").applyInPandas(send, "shard long, bucket long, wide binary, small binary, several binary"), "suffix-sent")
    answers = save(sent.groupBy("bucket").applyInPandas(answer, "shard long, bucket long, repeated binary"), "suffix-answers")
    discard(sent)

    def cover(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        info, wide, small = _counted(pdf, least)
        wide, small, n, place = distinct_keys(wide, small)
        repeated, reply = n > 1, dict(zip(replies["bucket"], replies["repeated"], strict=True))
        for b, i, j in _slices(wide, ranges):
            repeated[i:j] |= np.unpackbits(np.frombuffer(reply[b], np.uint8), count=j - i).astype(bool)
        at, out = 0, []
        for r, text, anchors, sure, count in info:
            hit = []
            for i, j in count:
                hit.append(np.flatnonzero(repeated[place[at : at + j - i + 1]]) + i)
                at += j - i + 1
            if bare := bare_windows(len(text), anchors, least):
                known = np.sort(np.array(r["keys"], np.int64).view(np.uint64))
                hit += [np.flatnonzero(_among(_bare_key(k), known)) + i for (i, _), k in zip(bare, _string_keys(text, bare, least)[0], strict=True)]
            gone = np.ones(len(text), bool) if r["copies"] > 1 else _cover(text, sure, hit, least)
            spans = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((r["dkey"], int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), [{"i": int(i), "j": int(j)} for i, j in spans] or None))
        return pd.DataFrame(out, columns=["dkey", "n_removed", "n_spans", "kept_sha256", "spans"])

    covered = sharded.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(cover, "dkey binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<i:long,j:long>>")
    covered = save(covered, "suffix-covered")
    discard(sharded, answers)
    none = F.lit(0).cast("long")
    return src.drop("text").join(covered, "dkey", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "spans"
    )
