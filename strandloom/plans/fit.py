"""End-to-end fit of a study: read tables, filter, fit, write the model.

    python -m strandloom.plans.fit DATA OUT configuration=ard k=20 var_filter=0.5
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.strings import options
from strandloom.operators.factor import FactorModel
from strandloom.operators.joins import set_weights
from strandloom.operators.select import keep, top_variance
from strandloom.sources.files import read_matrix

#: configuration: fsard, ard, graph or basic.
OPTIONS: dict[str, object] = {
    "configuration": "fsard", "k": 10, "epochs": 200, "outer": 10, "tolerance": 1e-5, "var_filter": 0.5, "ridge": 1.0, "selective_l1": 1.0, "network": 1.0, "weights": "EB", "joint": False, "rotate": True, "seed": 0,
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{name}")
    except Exception as e:  # the optional tables of a study
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def fit_study(spark: SparkSession, path: str, **chosen: object) -> FactorModel:
    """Fit the study in ``path``: obs, samples, features and, where it has them, batch_map, sets and edges (k, src, dst, weight).

    Keeps the share ``var_filter`` of each view's features with the largest
    variance.  Options are those of :data:`OPTIONS`.
    """
    if unknown := set(chosen) - set(OPTIONS):
        raise ValueError(f"unknown options {sorted(unknown)}")
    o = OPTIONS | chosen
    obs, samples, features = read_matrix(spark, path).drop("target"), spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/features")
    if o["var_filter"] < 1:
        top = top_variance(obs, o["var_filter"])
        obs, features = keep(obs, top, "feature_id"), keep(features, top, "feature_id")
    kind, sets, graphs = o["configuration"], None, None
    if kind == "fsard" and (members := _table(spark, path, "sets")) is not None:
        sets = set_weights(keep(members.select("view", "set_id", "feature_id"), features, "feature_id"))
    if kind == "graph" and (edges := _table(spark, path, "edges")) is not None:
        graphs = [[] for _ in range(o["k"])]
        for r in edges.where(F.col("k") < o["k"]).orderBy("k", "src", "dst").collect():  # graphs of a model's factors
            graphs[r["k"]].append((r["src"], r["dst"], r["weight"]))
    model = FactorModel(o["k"], prior=kind if kind in ("fsard", "ard") else "l2", ridge=o["ridge"], selective_l1=o["selective_l1"] if kind == "graph" else None, network=o["network"] if kind == "graph" else None)
    return model.fit(obs, samples, features, _table(spark, path, "batch_map"), sets, graphs, o["epochs"], o["outer"], o["tolerance"], o["weights"], o["joint"], o["rotate"], seed=o["seed"])


def main(args: list[str]) -> None:
    data, out, *rest = args
    spark = SparkSession.builder.getOrCreate()
    fit_study(spark, data, **options(OPTIONS, rest)).save(spark, out)


if __name__ == "__main__":
    main(sys.argv[1:])
