"""Exact maximum-inner-product search with one ball tree per shard.

Candidates are dealt by place: each goes to the cell of its nearest pivot, one
of at most ``CELLS`` vectors, and a cell is cut into shards of bounded size.  A
shard becomes a ball tree and is written once as one row.

A query visits cells in the order of its upper bound for their ball around the
pivot,  q.p + |q| r.  Round by round the current k-th score is shared: it decides
which cells a query still has to visit, before anything is shuffled, and it
prunes from the start in all shards of those cells.  Rounds visit one cell, two,
four and so on, until no bound reaches the k-th score.  Inside a shard nodes are
visited in the order of their bound and a node strictly below the k-th score is
cut, so ties are still seen.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import discard, save

SHARD_ROWS = 16384
BLOCK_ROWS = 512
CELLS = 1024
LEAF_ROWS = 64
#: no k-th score yet
_NONE = -(1 << 63)
_FOUND = "query_id long, vec_id long, score long"


def quantised(col: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(F.col(col), lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(col: str) -> Column:
    """The vector is there and all its components are there and finite."""
    c = F.col(col)
    whole = F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")))
    return c.isNotNull() & F.coalesce(whole, F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows as int64; shorter vectors are filled with zeros."""
    rows = [np.asarray(v, np.int64) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def build_tree(ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Ball tree: halves along the coordinate of the widest spread; node 0 is the root."""
    order, f = np.argsort(ids, kind="stable"), x.astype(np.float64)
    centre, radius, child, span, todo = [], [], [], [], [(0, len(ids))]
    for i, j in iter(lambda: todo.pop(0) if todo else None, None):
        own = f[order[i:j]]
        c = own.mean(axis=0) if j > i else np.zeros(x.shape[1])
        centre.append(c)
        radius.append(np.sqrt(((own - c) ** 2).sum(axis=1).max()) if j > i else 0.0)
        span.append((i, j))
        if j - i <= leaf_rows or not own.size or not np.ptp(own, axis=0).any():
            child.append(-1)
            continue
        d, m = np.ptp(own, axis=0).argmax(), (j - i) // 2
        order[i:j] = order[i:j][np.argpartition(own[:, d], m)]
        child.append(len(centre) + len(todo))
        todo += [(i, i + m), (i + m, j)]
    return {"ids": ids[order], "x": x[order], "centre": np.array(centre), "radius": np.array(radius), "child": np.array(child), "span": np.array(span)}


def search_tree(tree: dict[str, np.ndarray], ids: np.ndarray, q: np.ndarray, floor: list[int | None], k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, vector id, score) of the up to k best of each query in this tree.

    ``floor``: a k-th score known from other shards; lower scores are not returned.
    """
    x, dim = tree["x"], max(tree["x"].shape[1], q.shape[1])
    x, q = (np.pad(a, ((0, 0), (0, dim - a.shape[1]))) for a in (x, q))
    centre = np.pad(tree["centre"], ((0, 0), (0, dim - tree["centre"].shape[1])))
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim
    if top < 2**53:  # products and sums are exact in doubles
        x = x.astype(np.float64)
    qf = q.astype(np.float64)
    bounds = qf @ centre.T + np.sqrt((qf**2).sum(axis=1))[:, None] * tree["radius"]
    bounds += 1e-9 * (np.abs(bounds) + top) + 1e-6  # rounding may not cut a node
    child, span, own = tree["child"].tolist(), tree["span"].tolist(), tree["ids"]
    for n, qid in enumerate(ids.tolist()):
        b, v, kth = bounds[n].tolist(), qf[n] if x.dtype == np.float64 else q[n], floor[n]
        best: list[tuple[int, int]] = []  # smallest first: (score, -id)
        nodes = [(-b[0], 0)]
        while nodes:
            bound, at = heapq.heappop(nodes)
            if kth is not None and -bound < kth:
                break
            if child[at] >= 0:
                for c in (child[at], child[at] + 1):
                    if kth is None or b[c] >= kth:
                        heapq.heappush(nodes, (-b[c], c))
                continue
            i, j = span[at]
            scores, names = x[i:j] @ v, own[i:j]
            for m in np.flatnonzero((names != qid) & (scores >= (kth if kth is not None else -np.inf))).tolist():
                item = (int(scores[m]), -int(names[m]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (kth is None or best[0][0] > kth):
                kth = best[0][0]
        for score, name in best:
            yield qid, -name, score


def _pack(tree: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **tree)
    return out.getvalue()


def _bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of each query's scores in each cell (-inf: empty cell), never too small by rounding."""
    dim = max(q.shape[1], pivots.shape[1])
    f, p = (np.pad(a, ((0, 0), (0, dim - a.shape[1]))).astype(np.float64) for a in (q, pivots))
    spread = np.sqrt((f**2).sum(axis=1))[:, None] * np.maximum(radius, 0)
    out = f @ p.T + spread
    size = np.abs(f) @ np.abs(p).T + spread
    return np.where(radius < 0, -np.inf, out + 1e-9 * size + 1e-6)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Both tables have ``vec_id`` and ``vector`` (array<long>); only these columns
    are read.  Ties go to the smaller vec_id.  Rows with null ids take no part,
    nor do candidates with the query's own id.  Queries that repeat an id ask
    once, with the greatest of their vectors; repeated candidates all count.
    Shorter vectors count as filled up with zeros; scores have to fit a long.
    The driver holds at most ``cells`` pivots; any pivots give the same result.
    An empty table gives no rows.
    """
    cand = save(vectors.where("vec_id is not null").select("vec_id", "vector"), "topk-candidates")
    ask = queries.where("vec_id is not null").groupBy(F.col("vec_id").alias("query_id")).agg(F.max("vector").alias("vector"))
    wanted = max(1, min(cells, -(-cand.count() // shard_rows)))
    first = cand.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "vector").limit(wanted).toPandas()
    pivots = _matrix(first["vector"])
    wanted = len(pivots)
    if not wanted:
        return ask.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["vector"])
            dim = max(x.shape[1], pivots.shape[1])
            f, p = (np.pad(a, ((0, 0), (0, dim - a.shape[1]))).astype(np.float64) for a in (x, pivots))
            near = ((p**2).sum(axis=1) - 2 * f @ p.T).argmin(axis=1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vector": pdf["vector"], "cell": near, "far": np.sqrt(((f - p[near]) ** 2).sum(axis=1))})

    dealt = save(cand.mapInPandas(deal, "vec_id long, vector array<long>, cell long, far double"), "topk-dealt")
    discard(cand)
    radius, parts = np.full(wanted, -1.0), np.zeros(wanted, np.int64)
    for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
        radius[r["cell"]], parts[r["cell"]] = r["far"], -(-r["n"] // shard_rows)
    sizes = F.array(*(F.lit(int(n)) for n in parts))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.greatest(sizes[F.col("cell").cast("int")], F.lit(1))))

    def tree_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [_pack(build_tree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["vector"])))]})

    trees = save(dealt.groupBy("cell", "part").applyInPandas(tree_of, "cell long, part long, tree binary"), "topk-trees")

    def visits(first: int, last: int):
        """The cells at places first .. last - 1 of each query's order whose bound reaches its k-th score."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                bound = _bounds(_matrix(pdf["vector"]), pivots, radius)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                kth = pdf["kth"].to_numpy(np.float64)
                reach = np.take_along_axis(bound, order, axis=1)
                row, col = np.nonzero((reach >= kth[:, None]) & (reach > -np.inf))
                own = pdf.iloc[row]
                yield pd.DataFrame({"cell": order[row, col], "query_id": own["query_id"].to_numpy(), "vector": own["vector"].to_numpy(), "kth": own["kth"].to_numpy()})

        return run

    def search(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        for blob in pdf["tree"] if len(asked) else []:
            floor = [None if v == _NONE else v for v in asked["kth"].tolist()]
            rows += search_tree(dict(np.load(io.BytesIO(blob))), asked["query_id"].to_numpy(np.int64), _matrix(asked["vector"]), floor, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = None
    at, step = 0, 1
    while at < wanted:
        state = ask.withColumn("kth", F.lit(_NONE))
        if best is not None:
            known = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("known"))
            state = ask.join(known, "query_id", "left").select("query_id", "vector", F.coalesce("known", F.lit(_NONE)).alias("kth"))
        asked = save(state.mapInPandas(visits(at, at + step), "cell long, query_id long, vector array<long>, kth long"), "topk-asked")
        if best is not None and not asked.limit(1).count():
            break
        # a cell's queries go in blocks of bounded size to each of its trees; trees that nobody asks aren't moved
        counts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        counts = save(counts.withColumn("parts", sizes[F.col("cell").cast("int")]), "topk-counts")
        pairs = trees.join(counts.drop("parts"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        asked = asked.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        keys = ["cell", "part", "block"]
        found = pairs.select(*keys, "tree").groupBy(*keys).cogroup(asked.select(*keys, "query_id", "vector", "kth").groupBy(*keys)).applyInPandas(search, _FOUND)
        found = found if best is None else found.unionByName(best.drop("rank"))
        old, best = best, save(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "topk-best")
        if old is not None:
            discard(old)
        at, step = at + step, 2 * step
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
