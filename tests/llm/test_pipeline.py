from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as C
from strandloom.llm.packing import WordTokens, default_tokenizer


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Each stage written and read again, as the driver runs them."""
    docs, out = spark.read.parquet(f"{data}/sf0.01/documents.parquet"), []
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, f"{data}/sf0.01").write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip((n for n, _ in C.STAGES), out, strict=True))


def test_names_and_columns(stages):
    assert list(stages) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mix_sources", "pack_pow2"]
    for name, (before, after) in stages.items():
        assert after.columns == before.columns or name == "pack_pow2"


def test_exact_stage_keeps_the_largest_id(stages):
    before, after = ([(r.text, r.doc_id) for r in df.collect()] for df in stages["exact_dedup"])
    best = {}
    for t, d in before:
        best[t] = max(d, best.get(t, d))
    assert Counter(after) == Counter(best.items())


def test_near_stage_drops_only_near_copies(stages):
    before, after = stages["simhash_near_dedup"]
    kept = {r.doc_id for r in after.collect()}
    sets = {}
    for r in before.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for d, s in sets.items():
        near = [e for e, t in sets.items() if e != d and len(s & t) / max(1, len(s | t)) >= (0.8 if d in kept else 0.7)]
        assert near or d in kept
        if d in kept:
            assert not [e for e in near if e in kept]


def test_pack_stage_holds_all_tokens(stages):
    before, after = stages["pack_pow2"]
    w = WordTokens(default_tokenizer())
    want = sum(len(w.ids(r.text)) // 4 + 1 for r in before.select("text").collect())
    assert sum(r.length for r in after.collect()) == want


def test_run_equals_the_stages(spark, data, stages):
    got = C.run(spark, f"{data}/sf0.01").drop("sequence_id")
    want = stages["pack_pow2"][1].drop("sequence_id")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert C.ORACLE_SQL is None


def test_edge_and_empty(spark, data, edge, empty):
    for docs, some in ((edge, True), (empty, False)):
        columns = docs.columns
        for name, stage in C.STAGES:
            docs = stage(spark, docs, f"{data}/sf0.001")
            assert docs.columns == columns or name == "pack_pow2"
        assert (docs.count() > 0) == some


def test_stages_leave_no_copy_of_the_table(spark, data, tmp_path):
    size = lambda path: sum(f.stat().st_size for f in Path(path.removeprefix("file://")).rglob("*.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir")
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet").repartition(1)
    docs.write.parquet(str(tmp_path / "docs"))
    docs, before = spark.read.parquet(str(tmp_path / "docs")), size(shared)
    for name in ("exact_dedup", "simhash_near_dedup"):
        dict(C.STAGES)[name](spark, docs, f"{data}/sf0.01").write.parquet(str(tmp_path / name))
    assert size(shared) - before < size(str(tmp_path / "docs")) / 2
