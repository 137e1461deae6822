"""SimHash near-duplicates: fingerprints, sharded BK-trees, components.

Fingerprints within ``radius`` bits agree on some choice of ``bands - radius``
of ``bands`` bit bands (pigeonhole), so every such choice deals the *distinct*
fingerprints into shards.  A shard is searched with a BK-tree: children hang on
an edge labelled with their integer Hamming distance to the parent, and a
search follows only edges within the radius of the distance to the query.
Shards above ``shard_rows`` fingerprints are cut into blocks; the tree of every
block is sent to every other block of that shard, so no shard is ever gathered
whole and no link is lost.  A task returns a spanning forest of the links
it found, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import discard, row_id, rows_among, save, save_parts, shuffle_partitions, sliced, trimmed
from strandloom.llm.components import connected_components

SEED = 42
SHARD_ROWS = 4096
_CHUNK = 1 << 15
#: Keys before a key of a set that are looked at, so that two sets are paired once and not at each key they share.
_PRIOR = 4
#: Sets that share a shingle are paired by a join up to this number, in blocks inside tasks beyond it.
GROUP_ROWS = 64
#: Sets and hashes of a block, on average: a task holds two blocks at once.
BLOCK_ROWS = 256
_BLOCK_HASHES = 1 << 20
_COLUMNS = 4096
#: Rows and bytes that one pass shuffles; of rows at most MOST_PASSES, of bytes no pass below a PASS_SHARE-th of all sets.
PASS_ROWS, PASS_BYTES = 1 << 22, 1 << 28
MOST_PASSES, PASS_SHARE = 8, 8


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit set, bit 0 first."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):  # very long texts by chunks
        bits = np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # up to 255 rows add up in a byte each
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: str | None, words: int = 5) -> int:
    """64-bit SimHash: bit i is 1 if set in over half of the shingle hashes.

    A-Z are lowered, shingles are ``words`` consecutive words joined by a space,
    repeats included (fewer words: the whole sequence; none: 0).
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = bit_counts(h)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(fp.view(np.int64))], ["row_id", "doc_id", "fp"])

    return run


class BKTree:
    """Burkhard-Keller tree over unsigned 64-bit integers under Hamming distance."""

    __slots__ = ("children", "root")

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        if self.root is None:
            self.root, self.children[x] = x, {}
            return
        at = self.root
        while at != x:
            d = (at ^ x).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = x
                self.children[x] = {}
                return
            at = nxt

    def within(self, x: int, radius: int) -> list[int]:
        """All stored values within the radius of x."""
        if self.root is None:
            return []
        found, stack, children = [], [self.root], self.children
        while stack:
            at = stack.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def _links(tree: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of ``tree`` with ``queries`` (None: with itself), closest links first."""
    parent: dict[int, int] = {}
    kept: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    bk = BKTree()
    if queries is not None:
        for x in tree:
            bk.add(x)
    for x in tree if queries is None else queries:
        near = bk.within(x, radius)
        near.sort(key=lambda y: ((x ^ y).bit_count(), y))
        for y in near:
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                kept.append((x, y))
        if queries is None:
            bk.add(x)
    return kept


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (view, shard, i, j); one pair of shard blocks is held at a time."""
        key, tree, queries = None, [], []

        def flush() -> list[tuple[int, int]]:
            if key is None or len(tree) + len(queries) < 2:
                return []
            return _links(tree, None if key[2] == key[3] else queries, radius)

        for b in batches:
            views: list[int] = []
            pairs: list[tuple[int, int]] = []
            fps = b.column("fp").to_numpy().view(np.uint64).tolist()
            for *now, mine, x in zip(*(b.column(c).to_pylist() for c in ("view", "shard", "i", "j", "mine")), fps, strict=True):
                if now != key:
                    found = flush()
                    pairs += found
                    views += [key[0]] * len(found) if found else []
                    key, tree, queries = now, [], []
                (tree if mine == now[2] else queries).append(x)
            yield _pairs(views, pairs)
        found = flush()
        yield _pairs([key[0]] * len(found) if found else [], found)

    return run


def _pairs(views: list[int], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(views, pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["view", "a", "b"])


def band_count(n: int, radius: int) -> int:
    """Bands for ``n`` distinct fingerprints; more, longer keys keep shards small.

    Any value gives the same links; only the work differs.
    """
    return radius + (1 if n <= 4_000_000 else 2 if n <= 400_000_000 else 3)


def _shard_keys(bands: int, radius: int) -> list[tuple[int, int]]:
    """(salt, mask) of every choice of ``bands - radius`` of the bit bands."""
    cut = [64 * i // bands for i in range(bands + 1)]
    band = [((1 << cut[i + 1]) - (1 << cut[i])) for i in range(bands)]
    return [(k, sum(band[i] for i in pick)) for k, pick in enumerate(combinations(range(bands), bands - radius))]


def near_links(fps: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, bands: int | None = None, pass_rows: int = PASS_ROWS) -> DataFrame:
    """(view, a, b) links that connect exactly the fingerprints within ``radius`` bits, written in passes over the shards.

    ``fps`` has distinct rows (view int, fp long); only fingerprints of one view are compared.
    """
    spark, parts = fps.sparkSession, shuffle_partitions(fps.sparkSession)
    sizes = [n for _, n in fps.groupBy("view").count().collect()]
    # shards are those of one view, so its size decides how many there are
    masks = _shard_keys(bands or band_count(max(sizes, default=0), radius), radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed(m))), F.lit(k), F.col("view")) for k, m in masks))
    passes = row_passes(sum(sizes) * len(masks), pass_rows)
    some = [fps.select("view", "fp", F.explode(keys).alias("shard")).where(F.pmod("shard", F.lit(passes)) == p) for p in range(passes)]
    # few shards have more than one block: these are broadcast
    large = (rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select("shard", F.ceil(F.col("n") / shard_rows).alias("blocks")) for rows in some)
    large = save_parts(large, "near-shards")

    def found(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(large), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")))
        rows = rows.select("view", "shard", "mine", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("view", "shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
        dealt = rows.repartition(parts, "view", "shard", "i", "j").sortWithinPartitions("view", "shard", "i", "j", "fp")
        return dealt.mapInArrow(trimmed(_search(radius)), "view int, a long, b long")

    out = save_parts(map(found, some), "near-found")
    discard(large)
    return out


def row_passes(rows: int, most: int = PASS_ROWS) -> int:
    """Passes over ``rows`` rows: each takes ``most``, or a ``MOST_PASSES``-th if that is more."""
    return min(MOST_PASSES, max(1, -(-rows // most)))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """One row per input row: row_id, doc_id, fp, component_id, first.

    Rows whose fingerprints are joined by a chain of links (``radius`` or fewer
    differing bits) share component_id, the smallest doc_id among them (null
    ids are ignored; null if there is no other).  ``first`` marks one row of
    each component: smallest doc_id, nulls last, then smallest row_id.  Null and
    empty texts have fingerprint zero and link like any other.  Other columns
    of ``docs`` are not read; an empty table gives no rows.
    """
    src = docs.select(row_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = save(src.mapInArrow(trimmed(_fingerprints(words)), "row_id long, doc_id long, fp long"), "simhash-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")
    nodes = save(rows.groupBy("fp").agg(F.min(rank).alias("low")), "simhash-nodes")
    links = near_links(nodes.select(F.lit(0).alias("view"), "fp"), radius).select("a", "b")
    roots = connected_components(links)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = save(rooted, "simhash-roots")
    low = rooted.groupBy("root").agg(F.min("low").alias("low"))
    named = rooted.select("fp", "root").join(low, "root").select("fp", "low")
    return rows.join(named, "fp").select(
        "row_id", "doc_id", "fp", F.col("low.doc_id").alias("component_id"), (F.col("row_id") == F.col("low.row_id")).alias("first")
    )


def word_fingerprints(h: np.ndarray, views: int) -> list[int]:
    """``views`` independent SimHashes of a set of word hashes, signed."""
    out = []
    with np.errstate(over="ignore"):
        for v in range(views):
            x = (h ^ np.uint64((v + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            out.append(int(np.packbits(bit_counts(x) * 2 > len(x), bitorder="little").view(np.int64)[0]))
    return out


def shingle_set(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the set of words, and of the set of ``words``-word shingles (fewer words: the whole sequence)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    with np.errstate(over="ignore"):
        h = np.full(len(parts) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ each[i : len(parts) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return np.unique(each), np.unique(h)


def least_overlap(n: int, m: int, similarity: float) -> int:
    """Shingles that sets of ``n`` and ``m`` share at the least if their Jaccard similarity reaches ``similarity``."""
    return math.ceil(similarity / (1 + similarity) * (n + m) - 1e-6)


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in an order that all sets share, so many that two near sets have one in common.

    Common shingles (``common``, sorted, with ``counts``) come last, the
    commonest at the very end.  Any one order gives the same links; only the
    work differs.
    """
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(common[at] == shingles, counts[at], 0)))]
    return shingles[: n - math.ceil(similarity * n - 1e-6) + 1]


def histogram(shingles: np.ndarray) -> bytes:
    """How many shingles begin with each bit pattern, a byte each (255 stands for more); about as many patterns as shingles."""
    if not len(shingles):
        return b""
    bits = min(16, max(1, (len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_be_near(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """False only if two sets of ``n`` and ``m`` shingles with histograms ``a`` and ``b`` can't reach ``similarity``.

    The histograms' distance is never above the number of shingles that only one
    set has; patterns of the longer one are joined to those of the shorter.
    """
    need = least_overlap(n, m, similarity)
    if need > min(n, m):
        return False
    if not a or not b:
        return len(a) == len(b)
    x, y = (np.frombuffer(h, np.uint8).astype(np.int32) for h in (a, b))
    size = min(len(x), len(y))
    return int(np.abs(x.reshape(size, -1).sum(axis=1) - y.reshape(size, -1).sum(axis=1)).sum()) <= n + m - 2 * need


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets (1 if both are empty)."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets ``xs`` shares with each of the sets ``ys``."""
    out = np.zeros((len(xs), len(ys)))
    rows = [np.repeat(np.arange(len(s)), list(map(len, s))) for s in (xs, ys)]
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (xs, ys)]
    both = np.intersect1d(*flat)
    # what one side alone has adds nothing; the rest is numbered
    ends = []
    for r, h in zip(rows, flat, strict=True):
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        there = both[at] == h if len(both) else np.zeros(len(h), bool)
        order = np.argsort(at[there], kind="stable")
        ends.append((r[there][order], at[there][order]))
    for start in range(0, len(both), _COLUMNS):
        side = []
        for s, (r, at) in zip((xs, ys), ends, strict=True):
            i, j = np.searchsorted(at, (start, start + _COLUMNS))
            m = np.zeros((len(s), _COLUMNS), np.float32)
            m[r[i:j], at[i:j] - start] = 1
            side.append(m)
        out += side[0] @ side[1].T
    return out


def _block_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, i, j); the two blocks of one cell are held at a time.  A forest of links between roots comes out."""
        key, sides = None, ([], [])

        def flush() -> pa.RecordBatch:
            parent: dict[int, int] = {}
            kept: list[tuple[int, int]] = []

            def find(x: int) -> int:
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[p]
                return x

            xs, ys = sides
            if xs and ys:
                sets = [[s for *_, s in side] for side in sides]
                n, m = (np.array(list(map(len, s)), float) for s in sets)
                both = overlaps(*sets)
                # what has words shares nothing with what has none, and the latter are one set
                near = both / np.maximum(n[:, None] + m[None, :] - both, 1) >= similarity
                near &= np.array([r for _, r, _ in xs])[:, None] != np.array([r for _, r, _ in ys])
                for i, j in zip(*np.nonzero(near), strict=True):
                    p, q = find(xs[i][1]), find(ys[j][1])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        kept.append((xs[i][0], ys[j][0]))
            ends = np.array(kept, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for b in sliced(batches):
            names = ("key", "i", "j", "side", "row_id", "root", "shingles")
            for *now, side, row, root, s in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if now != key:
                    yield flush()
                    key, sides = now, ([], [])
                sides[side].append((row, root, np.frombuffer(s, np.uint64)))
        yield flush()

    return run


def block_links(met: DataFrame, known: DataFrame, groups: DataFrame, similarity: float, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(a, b) links that connect exactly the roots of near sets in each group, at most one less than the roots of a cell.

    ``met`` has (row_id, n, key, root, open), ``known`` the sets by row_id and
    ``groups`` (key, rows, opens): blocks of all members and of the open ones.
    Every block of open sets meets every block of its group in one cell.  The
    cells are gone through in passes of about ``pass_bytes`` bytes, and written.
    """
    at = lambda n, salt: F.pmod(F.xxhash64("row_id", F.lit(salt)), F.col(n))
    cell = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = F.when(F.col("open"), F.transform(to("rows"), lambda j: cell(0, at("opens", 7), j)))
    cells = F.concat(F.coalesce(mine, F.array().cast("array<struct<side:int,i:bigint,j:bigint>>")), F.transform(to("opens"), lambda i: cell(1, i, at("rows", 13))))
    rows = save(met.join(F.broadcast(groups), "key").select("key", "row_id", "n", "root", F.inline(cells)), "near-cells")
    passes = byte_passes(rows.agg(F.sum("n")).first()[0], pass_bytes)
    parts = shuffle_partitions(met.sparkSession)

    def found(p: int) -> DataFrame:
        some = rows.where(F.pmod(F.xxhash64("key", "i", "j", F.lit(17)), F.lit(passes)) == p).drop("n")
        # only the sets that a pass needs are shuffled
        asked = known if passes == 1 else rows_among(known, "row_id", some)
        dealt = some.join(asked, "row_id").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        return dealt.mapInArrow(trimmed(_block_links(similarity)), "a long, b long")

    out = save_parts(map(found, range(passes)), "near-links")
    discard(rows)
    return out


def _dealt(df: DataFrame, column: str, passes: int) -> Iterator[DataFrame]:
    """``df`` in parts by the hash of ``column``."""
    return (df.where(F.pmod(F.xxhash64(column, F.lit(19)), F.lit(passes)) == p) for p in range(passes))


def byte_passes(hashes: int | None, most: int) -> int:
    """Passes over sets of ``hashes`` hashes in all, each of about ``most`` bytes."""
    return max(1, -(-8 * (hashes or 0) // most))


def common_shingles(src: DataFrame, words: int, sampled: int = 10_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in three or more of about ``sampled`` rows, or of each 24th if that is more, sorted, and their counts; only the order of prefixes hangs on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words)[1].view(np.int64))], ["key"])

    step = min(max(1, src.count() // sampled), 24)
    some = src.where(F.pmod(F.xxhash64("row_id", F.lit(11)), F.lit(step)) == 0)
    found = save(some.select("text").mapInArrow(trimmed(run), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2"), "near-common")
    rows = found.orderBy(F.desc("n"), "key").limit(most).toArrow()
    discard(found)
    keys, counts = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, views: int = 3, radius: int = 4, row: str | None = None, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS, pass_rows: int = PASS_ROWS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per input row: row_id, doc_id, component_id, first (as in :func:`simhash_components`).

    ``row`` names a column that numbers the rows of a written table; without it
    doc_id and text are written once with numbers.

    Documents are near duplicates if the Jaccard similarity of their sets of
    ``words``-word shingles is ``similarity`` or more.  Links are exact, up to
    collisions of 64-bit hashes, and found in three steps.  Rows with the same
    set stand for each other.  Most other links come from ``views`` SimHashes
    of the set of words, searched with BK-trees at ``radius``.  These neither
    find all pairs nor keep all that they find, so prefix filtering completes
    them: two near sets share one of the first n - ceil(similarity n) + 1 of
    their n shingles in any order that is the same for all sets.  Of the rows
    that do, neighbours by size are candidates at once, and all pairs that these
    links don't connect after that.  Every candidate
    is decided on the whole sets; histograms of the sets, compared before that,
    only drop pairs that can't reach ``similarity``.  Where more than
    ``group_rows`` rows share one shingle, such pairs are not written out: blocks
    of about ``block_rows`` whole sets meet in tasks, and only links come out.
    What has to meet in a shuffle meets in passes: each takes about ``pass_rows``
    rows or ``pass_bytes`` bytes, or a fixed share of the input if that is more,
    and leaves no shuffle files.
    Texts without words are near duplicates of each other.  A text of any length
    is read whole by one task.  Other columns are not read; an empty table gives
    no rows.
    """
    src = docs.select(row_id(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src if row else save(src, "near-source")
    common, counts = common_shingles(src, words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            digests, sizes, fps, sketches, firsts = [], [], [], [], []
            for t in b.column("text"):
                each, shingles = shingle_set(t.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sizes.append(len(shingles))
                fps.append(word_fingerprints(each, views))
                sketches.append(histogram(shingles))
                firsts.append(prefix(shingles, similarity, common, counts).view(np.int64))
            longs = pa.list_(pa.int64())
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, longs), pa.array(sketches, pa.binary()), pa.array(firsts, longs)]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), *columns], ["row_id", "doc_id", "digest", "n", "fps", "sketch", "prefix"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = pa.array([shingle_set(t.as_py(), words)[1].tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), sets], ["row_id", "shingles"])

    def keep(test, names):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                ok = [test(*x) for x in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
                yield b.select(names).filter(pa.array(ok, pa.bool_()))

        return trimmed(run)

    scanned = save(src.mapInArrow(trimmed(scan), "row_id long, doc_id long, digest binary, n long, fps array<long>, sketch binary, prefix array<long>"), "near-rows")
    # of rows with one set or fingerprint the first by doc_id stands for it, whatever the files' order
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id"))["row_id"]
    sets = save(scanned.groupBy("digest").agg(first.alias("low")), "near-sets")
    only = rows_among(scanned, "row_id", sets.select(F.col("low").alias("row_id")))

    seen = only.select("row_id", "doc_id", F.posexplode("fps").alias("view", "fp"))
    nodes = save(seen.groupBy("view", "fp").agg(first.alias("low")), "near-nodes")
    found = near_links(nodes.select("view", "fp"), radius, pass_rows=pass_rows)
    end = lambda x: nodes.select("view", F.col("fp").alias(x), F.col("low").alias(f"row_{x}"))
    pairs = found.join(end("a"), ["view", "a"]).join(end("b"), ["view", "b"]).select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    same = seen.join(nodes, ["view", "fp"]).where(F.col("row_id") != F.col("low")).select(F.col("low").alias("a"), F.col("row_id").alias("b"))

    # all rows of a shingle are in one pass
    sums = only.agg(F.sum("n"), F.sum(F.size("prefix")), F.count(F.lit(1))).first()
    keyed = only.select("row_id", "n", F.posexplode("prefix").alias("at", "key"))
    counted = (x.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("key"))) for x in _dealt(keyed, "key", row_passes(sums[1] or 0, pass_rows)))
    shared = save_parts((x.where("rows > 1").drop("rows") for x in counted), "near-prefixes")
    passes = row_passes(shared.count(), pass_rows)
    pass_bytes = max(pass_bytes, 8 * (sums[0] or 0) // PASS_SHARE)
    # neighbours in a group by size, and its first: that connects most of a large group of copies
    order = Window.partitionBy("key").orderBy("n", "row_id")
    ends = [F.struct(f("row_id").over(order).alias("a"), f("n").over(order).alias("n_a")) for f in (F.lag, F.first)]
    beside = (x.withColumn("o", F.array(*ends)).select("row_id", "n", F.explode("o").alias("o")).where(F.col("o.n_a") >= similarity * F.col("n") - 1e-6) for x in _dealt(shared, "key", passes))
    beside = (x.select(F.col("o.a").alias("a"), F.col("row_id").alias("b")) for x in beside)
    near = save_parts((x.distinct() for x in chain((pairs, same), beside)), "near-beside")
    rows = save(scanned.select("row_id", "doc_id", "digest", "n", "sketch"), "near-rows")
    discard(scanned, nodes, found)
    equal = rows.join(sets, "digest").where(F.col("row_id") != F.col("low")).select(F.col("low").alias("a"), F.col("row_id").alias("b"))

    def asked(df: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of ``df`` in any of the pairs."""
        return rows_among(df, "row_id", pairs.select(F.explode(F.array("a", "b")).alias("row_id")))

    def joined(pairs: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
        """The pairs with the columns of both rows."""
        of = lambda x: known.select(F.col("row_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity suffices; sketches and sets are joined to them in passes."""
        candidates = save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "near-candidates")
        # a sketch has up to two bytes a hash
        of = byte_passes(2 * candidates.count() * (sums[0] or 0) // max(1, sums[2]), 4 * pass_bytes)
        drawn = rows.select("row_id", "sketch", "n")
        both = (joined(x, asked(drawn, x), "sketch", "n") for x in _dealt(candidates, "a", of))
        may = keep(lambda a, b, n, m: may_be_near(a, b, n, m, similarity), ["a", "b", "n_a", "n_b"])
        left = save_parts((x.mapInArrow(may, "a long, b long, n_a long, n_b long") for x in both), "near-pairs")
        # whole sets are made anew in each pass
        of = byte_passes(left.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0], pass_bytes)
        near = keep(lambda a, b: jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similarity, ["a", "b"])

        def found() -> Iterator[DataFrame]:
            for some in _dealt(left.select("a", "b"), "a", of):
                known = save(asked(src.select("row_id", "text"), some).mapInArrow(trimmed(whole), "row_id long, shingles binary"), "near-shingles")
                yield joined(some, known, "shingles").mapInArrow(near, "a long, b long")
                discard(known)

        out = save_parts(found(), "near-links")
        discard(candidates, left)
        return out

    links = verified(near)
    discard(near)

    def rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
        return df.join(roots, "row_id", "left").withColumn("root", F.coalesce("root", "row_id"))

    # then all pairs that aren't connected: one of the two is outside the largest component of its group
    roots = connected_components(links).withColumnRenamed("node", "row_id")
    state = save_parts((rooted(x, roots) for x in _dealt(shared, "row_id", passes)), "near-state")
    discard(shared)
    main = (x.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows")) for x in _dealt(state, "key", passes))
    main = (x.groupBy("key").agg(F.max(F.struct("rows", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1") for x in main)
    main = save_parts((x.select("key", "main") for x in main), "near-main")
    met = save_parts((x.join(main, "key").select("row_id", "n", "at", "key", "root", (F.col("root") != F.col("main")).alias("open")) for x in _dealt(state, "key", passes)), "near-met")
    discard(state, main)
    # two sets that share one of the keys before this one have met there, where more was still to come
    before = Window.partitionBy("row_id").orderBy("at")
    prior = [f"prior{i}" for i in range(_PRIOR)]
    plain, passes = met, row_passes(met.count(), pass_rows)
    met = save_parts((x.withColumns({p: F.lag("key", i + 1).over(before) for i, p in enumerate(prior)}) for x in _dealt(plain, "row_id", passes)), "near-met")
    discard(plain)
    # large groups meet in blocks: their pairs grow with the square, their blocks' rows don't become rows of a join
    blocks = lambda some: F.ceil(F.greatest(F.count(some) / block_rows, F.sum(F.when(some, F.col("n"))) / _BLOCK_HASHES))
    large = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), blocks(F.lit(True)).alias("rows"), blocks(F.when(F.col("open"), True)).alias("opens"))
    large = save(large.where(F.col("size") > group_rows).drop("size"), "near-large")
    inside = met.join(F.broadcast(large.select("key")), "key", "left_semi").select("row_id", "n", "key", "root", "open")
    known = save(rows_among(src.select("row_id", "text"), "row_id", inside).mapInArrow(trimmed(whole), "row_id long, shingles binary"), "near-shingles")
    links = links.unionByName(block_links(inside, known, large, similarity, pass_bytes))
    discard(known)
    small = met.join(F.broadcast(large.select("key")), "key", "left_anti")
    sooner = F.coalesce(F.arrays_overlap(*(F.array(*(F.col(f"{side}.{p}") for p in prior)) for side in "xy")), F.lit(False))
    need = F.ceil((F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6)
    # at the first shingle that two sets share, all that they share is still to come
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    once = ~F.col("y.open") | (F.col("x.row_id") < F.col("y.row_id"))
    pairs = (z.where("open").alias("x").join(z.alias("y"), F.col("x.key") == F.col("y.key")) for z in _dealt(small, "key", passes))
    pairs = (z.where((F.col("x.root") != F.col("y.root")) & once & (rest >= need) & ~sooner) for z in pairs)
    pairs = save_parts((z.select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b")).distinct() for z in pairs), "near-open")
    links = links.unionByName(verified(pairs))
    discard(pairs)

    links = save(links.unionByName(equal), "near-links")
    named = save(rooted(rows.select("row_id", "doc_id"), connected_components(links).withColumnRenamed("node", "row_id")), "near-roots")
    discard(rows, sets, met, large, *([] if row else [src]))
    low = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")).alias("low"))
    return named.join(low, "root").select("row_id", "doc_id", F.col("low.doc_id").alias("component_id"), (F.col("row_id") == F.col("low.row_id")).alias("first"))
