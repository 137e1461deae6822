"""Graphs and feature sets: node sets, central-dogma edges, Laplacians, pruning, corruption.

edges(pathway_id, pos, src, dst, weight); undirected unless said otherwise.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.strings import DOGMA, compound, data_edge_target
from strandloom.operators.ranged import positions
from strandloom.sources.scratch import save


def nodes(edges: DataFrame, *by: str) -> DataFrame:
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct()


def entities(edges: DataFrame, *by: str) -> DataFrame:
    """Distinct genes of the nodes (text before the first '_')."""
    return nodes(edges, *by).select(*by, F.split("node", "_")[0].alias("entity")).distinct()


def undirected(edges: DataFrame, *by: str) -> DataFrame:
    """Latest weight of each undirected edge: by, lo, hi, weight."""
    e = edges.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    return e.groupBy(*by, "lo", "hi").agg(F.max(F.struct("pos", "weight"))["weight"].alias("weight"))


def adjacency(edges: DataFrame, *by: str) -> DataFrame:
    """Both directions of every undirected edge (a self loop once): by, src, dst, weight."""
    u = undirected(edges, *by)
    there = u.select(*by, F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")
    return there.unionByName(u.where("lo <> hi").select(*by, F.col("hi").alias("src"), F.col("lo").alias("dst"), "weight"))


def node_degrees(edges: DataFrame, *by: str) -> DataFrame:
    """Degrees over distinct undirected edges; self loops count twice."""
    u = edges.select(*by, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    return u.select(*by, F.explode(F.array("lo", "hi")).alias("node")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))


def signed_edges(edges: DataFrame, *by: str) -> DataFrame:
    """Distinct undirected edges with their sign."""
    return edges.select(*by, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.signum("weight").cast("int").alias("sign")).distinct()


def dogma_edges(genes: DataFrame) -> DataFrame:
    """dna -> mrna -> protein -> activation of each gene, weight 1."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(DOGMA, DOGMA[1:], strict=False))))
    return genes.select("gene", steps.alias("s")).select(compound(F.col("gene"), F.col("s.a")).alias("src"), compound(F.col("gene"), F.col("s.b")).alias("dst"), F.lit(1.0).alias("weight"))


def data_edges(features: DataFrame) -> DataFrame:
    """Feature (gene_level_id) to its gene_level node with the feature's weight."""
    return features.select(F.col("feature").alias("src"), data_edge_target(F.col("feature")).alias("dst"), "weight")


def extend_pathways(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Pathway edges with the dogma chain and data edges of the pathway's genes.

    ``features``: feature (gene_level_id), gene, weight.  Genes without data get
    the chain alone.  Pathways are not pruned; see :func:`prune_leaves`.
    """
    genes = entities(edges, "pathway_id").withColumnRenamed("entity", "gene")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(DOGMA, DOGMA[1:], strict=False))))
    chain = genes.select("pathway_id", "gene", steps.alias("s")).select("pathway_id", compound(F.col("gene"), F.col("s.a")).alias("src"), compound(F.col("gene"), F.col("s.b")).alias("dst"), F.lit(1.0).alias("weight"))
    data = genes.join(features, "gene").select("pathway_id", F.col("feature").alias("src"), data_edge_target(F.col("feature")).alias("dst"), "weight")
    return chain.unionByName(data).unionByName(edges.select("pathway_id", "src", "dst", "weight"))


def laplacian(edges: DataFrame, epsilon: float = 0.0, *by: str) -> DataFrame:
    """Signed Laplacian entries: by, i, j, v.  Diagonal epsilon + sum of |w|, off-diagonal -w; latest edge wins.

    A self loop adds 2 |w| - 2 w to its diagonal entry.
    """
    u = undirected(edges, *by)
    ends = u.select(*by, F.explode(F.array("lo", "hi")).alias("i"), F.abs("weight").alias("a"))
    loops = u.where("lo = hi").select(*by, F.col("lo").alias("i"), (-2 * F.col("weight")).alias("a"))
    diagonal = ends.unionByName(loops).groupBy(*by, "i").agg((F.sum("a") + epsilon).alias("v")).select(*by, "i", F.col("i").alias("j"), "v")
    off = adjacency(edges.where("src <> dst"), *by).select(*by, F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("v"))
    return diagonal.unionByName(off)


def quadratic_form(lap: DataFrame, x: DataFrame, *by: str) -> DataFrame:
    """x' L x for the values x(i, x)."""
    left, right = x.select("i", F.col("x").alias("xi")), x.select(F.col("i").alias("j"), F.col("x").alias("xj"))
    return lap.join(left, "i").join(right, "j").groupBy(*by).agg(F.sum(F.col("v") * F.col("xi") * F.col("xj")).alias("q"))


def _prune(pdf: pd.DataFrame, spared: set[str]) -> pd.DataFrame:
    near: dict[str, set[str]] = {}
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    front = [v for v in near if len(near[v]) < 2 and v not in spared]
    while front:
        v = front.pop()
        for u in near.pop(v, set()) - {v}:
            near[u].discard(v)
            if len(near[u]) < 2 and u not in spared:
                front.append(u)
    return pdf[[a in near and b in near for a, b in zip(pdf["src"], pdf["dst"], strict=True)]]


def prune_leaves(edges: DataFrame, spared: list[str] = ()) -> DataFrame:
    """Edges left when nodes of degree below 2 are removed again and again, ``spared`` nodes excepted.

    One pathway fits a task; pathways run in parallel.
    """
    hold = set(spared)
    return edges.groupBy("pathway_id").applyInPandas(lambda pdf: _prune(pdf, hold), edges.schema)


def quadratic_with_virtual(aa: np.ndarray, ab: np.ndarray, bb: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient in x and best virtual values u of  1/2 (x'AAx + 2x'ABu + u'BBu)."""
    u = np.linalg.solve(bb, -(ab.T @ x)) if len(bb) else np.zeros(0)
    grad = aa @ x + ab @ u
    return float(0.5 * (x @ aa @ x + 2 * x @ ab @ u + u @ bb @ u)), grad, u


def laplacian_blocks(edges: list[tuple[str, str, float]], observed: list[str], epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """AA, AB, BB blocks (observed, virtual nodes) of one small graph and its virtual nodes, sorted."""
    virtual = sorted({v for a, b, _ in edges for v in (a, b)} - set(observed))
    at = {v: i for i, v in enumerate([*observed, *virtual])}
    lap = np.zeros((len(at), len(at)))
    for (a, b), w in {tuple(sorted((a, b))): w for a, b, w in edges}.items():
        i, j = at[a], at[b]
        lap[i, i] += abs(w)
        lap[j, j] += abs(w)
        lap[i, j] -= w
        lap[j, i] -= w
    lap[np.diag_indices(len(at))] += epsilon
    n = len(observed)
    return lap[:n, :n], lap[:n, n:], lap[n:, n:], virtual


def network_penalty(edges: DataFrame, x: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """(pathway_id, loss): quadratic form of each pathway's graph with its unobserved nodes at their best.

    ``x``: node, x (observed values).  A pathway's graph and its own values fit a task.
    """

    def solve(key: tuple, g: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        values = dict(zip(own["node"], own["x"], strict=True))
        seen = sorted(values)
        if not len(g):
            return pd.DataFrame({"pathway_id": [], "loss": []})
        aa, ab, bb, _ = laplacian_blocks(list(zip(g["src"], g["dst"], g["weight"], strict=True)), seen, epsilon)
        return pd.DataFrame({"pathway_id": [key[0]], "loss": [quadratic_with_virtual(aa, ab, bb, np.array([values[v] for v in seen]))[0]]})

    own = nodes(edges, "pathway_id").join(x, "node").select(F.col("pathway_id").alias("pathway_id"), "node", "x")
    latest = undirected(edges, "pathway_id").select("pathway_id", F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")
    kind = edges.schema["pathway_id"].dataType.simpleString()
    return latest.groupBy("pathway_id").cogroup(own.groupBy("pathway_id")).applyInPandas(solve, f"pathway_id {kind}, loss double")


def _rng(key: object, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def _rewire(key: tuple, pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """A random graph by degrees: the node with the most degree left meets a random non-neighbour with some left.

    Without one, a non-neighbour drawn by its first degree; degrees then differ.
    """
    rng, out = _rng(key[0], seed), []
    for w, part in pdf.groupby("weight", sort=True):
        pairs = sorted({tuple(sorted(p)) for p in zip(part["src"], part["dst"], strict=True)})
        degree: dict[str, int] = {}
        for p in pairs:
            for v in p:
                degree[v] = degree.get(v, 0) + 1
        names, left = sorted(degree), dict(degree)
        weight = np.array([degree[v] for v in names], float)
        heap, near = [(-n, v) for v, n in left.items()], {v: {v} for v in names}
        heapq.heapify(heap)
        while heap:
            n, v = heapq.heappop(heap)
            if left[v] != -n or not n:  # an old entry
                continue
            u = None
            for _ in range(8):  # most draws hit
                x = names[int(rng.integers(len(names)))]
                if left[x] > 0 and x not in near[v]:
                    u = x
                    break
            if u is None:
                free = [x for x in names if left[x] > 0 and x not in near[v]]
                if free:
                    u = free[int(rng.integers(len(free)))]
                else:
                    p = np.where([x in near[v] for x in names], 0.0, weight)
                    u = names[int(rng.choice(len(names), p=p / p.sum()))] if p.sum() else None
            if u is None:
                left[v] = 0
                continue
            near[u].add(v)
            near[v].add(u)
            out.append((key[0], *sorted((u, v)), w))
            for x in (u, v):
                left[x] = max(0, left[x] - 1)
                heapq.heappush(heap, (-left[x], x))
    return pd.DataFrame(sorted(out, key=lambda e: (e[3], e[1], e[2])), columns=["pathway_id", "src", "dst", "weight"])


def rewire(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Random graph with (nearly) the degrees of each pathway, positive and negative edges apart."""
    kind = edges.schema["pathway_id"].dataType.simpleString()
    return edges.select("pathway_id", "src", "dst", "weight").groupBy("pathway_id").applyInPandas(lambda k, pdf: _rewire(k, pdf, seed), f"pathway_id {kind}, src string, dst string, weight double")


def _corrupt(key: tuple, pdf: pd.DataFrame, pool: list[str], remove: float, add: float, seed: int) -> pd.DataFrame:
    rng = _rng(key[0], seed)
    own = sorted({*pdf["src"], *pdf["dst"]})
    gone = set(rng.choice(own, math.ceil(remove * len(own)), replace=False)) if remove else set()
    kept = pdf[~pdf["src"].isin(gone) & ~pdf["dst"].isin(gone)]
    degree = pd.concat([kept["src"], kept["dst"]]).value_counts().sort_index()
    fresh = [v for v in pool if v not in set(own)]
    new = rng.choice(fresh, min(len(fresh), math.ceil(add * len(own))), replace=False) if add and fresh and len(degree) else []
    to = rng.choice(degree.index, len(new), p=degree / degree.sum()) if len(new) else []
    extra = pd.DataFrame({"pathway_id": [key[0]] * len(new), "src": list(map(str, new)), "dst": list(map(str, to)), "weight": [1.0] * len(new)})
    return pd.concat([kept[["pathway_id", "src", "dst", "weight"]], extra]) if len(new) else kept[["pathway_id", "src", "dst", "weight"]]


def corrupt_nodes(edges: DataFrame, pool: list[str], remove: float, add: float, seed: int = 0) -> DataFrame:
    """Remove ceil(remove * n) nodes of each pathway and attach ceil(add * n) nodes of the pool by degree."""
    kind = edges.schema["pathway_id"].dataType.simpleString()
    pool = sorted(pool)
    return edges.select("pathway_id", "src", "dst", "weight").groupBy("pathway_id").applyInPandas(lambda k, pdf: _corrupt(k, pdf, pool, remove, add, seed), f"pathway_id {kind}, src string, dst string, weight double")


def corrupt_list(graphs: DataFrame, pool: DataFrame, remove: float, add: float, seed: int = 0) -> DataFrame:
    """Pathway list with ceil(remove n) dropped and ceil(add n) of ``pool`` added, drawn by weight.

    ``graphs``: pathway_id; ``pool``: pathway_id, weight (other pathways).  Draws
    keep the largest keys  ln(u) / weight  with u from a hash of the id.
    """
    n = graphs.count()
    u = lambda salt: (F.pmod(F.xxhash64("pathway_id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    kept = graphs.select("pathway_id").orderBy(u(0), "pathway_id").limit(n - math.ceil(remove * n))
    fresh = pool.join(graphs.select("pathway_id"), "pathway_id", "left_anti").where("weight > 0")
    return kept.unionByName(fresh.orderBy((F.ln(u(1)) / F.col("weight")).desc(), "pathway_id").limit(math.ceil(add * n)).select("pathway_id"))


def rank_cover(sets: DataFrame) -> DataFrame:
    """(rank, set_id, new): greedy cover of all sets, by newly covered members, then size, then name.

    ``sets``: set_id, member.  Each round is one aggregate and one anti-join in
    Spark and only the chosen set comes to the driver.  Once all members are
    covered the other sets follow by size and name in one sort.
    """
    own = sets.select(F.col("set_id").cast("string").alias("set_id"), "member").distinct()
    own = save(own, "cover-sets")
    total = own.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    left, taken = own, []
    while (row := left.groupBy("set_id").agg(F.count(F.lit(1)).alias("new")).join(total, "set_id").orderBy(F.col("new").desc(), F.col("size").desc(), "set_id").first()) is not None:
        taken.append((len(taken) + 1, row["set_id"], row["new"]))
        left = save(left.join(own.where(F.col("set_id") == row["set_id"]).select("member"), "member", "left_anti"), "cover-left")
    head = sets.sparkSession.createDataFrame(taken, "rank long, set_id string, new long")
    rest = total.join(head.select("set_id"), "set_id", "left_anti")
    tail = positions(rest, [], F.col("size").desc(), F.col("set_id"), name="rank")
    return head.unionByName(tail.select((F.col("rank") + len(taken)).cast("long").alias("rank"), "set_id", F.lit(0).cast("long").alias("new")))


def jaccard(sets: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, jaccard) of the pairs of sets that share a member and reach ``least``, a < b.

    With ``least`` above 0 only pairs that share one of their first
    n - ceil(least n) + 1 members, rare members first, are compared: any pair
    that reaches it does.
    """
    s = sets.select("set_id", "member").distinct()
    size = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    first = s
    if least > 0:
        common = s.groupBy("member").agg(F.count(F.lit(1)).alias("in_sets"))
        nth = F.row_number().over(Window.partitionBy("set_id").orderBy("in_sets", "member"))
        first = s.join(common, "member").join(size, "set_id").withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    pairs = first.select(F.col("set_id").alias("a"), "member").join(first.select(F.col("set_id").alias("b"), "member"), "member").where("a < b").select("a", "b").distinct()
    own = s.select(F.col("set_id").alias("a"), "member")
    both = pairs.join(own, "a").join(s.select(F.col("set_id").alias("b"), "member"), ["b", "member"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    na, nb = size.toDF("a", "na"), size.toDF("b", "nb")
    out = both.join(na, "a").join(nb, "b").select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))
    return out.where(F.col("jaccard") >= least)


def membership_ids(features: DataFrame) -> DataFrame:
    """gene_i names of features: the gene and the feature's position from 1."""
    return features.withColumn("name", compound(F.col("gene"), F.row_number().over(Window.orderBy("pos")).cast("string")))
