"""Results hang on the rows alone, not on how a scan is split; samples are bounded by rows."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from strandloom.llm import language_id as L
from strandloom.llm import quality as Q
from strandloom.llm.common import fresh, heavy_join, identified, rows_among, save
from strandloom.llm.mixing import mix_sources, taken_words
from strandloom.llm.simhash import near_duplicates
from strandloom.llm.substring_dedup import substring_dedup
from strandloom.llm.suffix_dedup import remove_repeats

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def resplit(spark, monkeypatch):
    """Every later scan of a table is split in another way."""
    reads = [0]
    real = type(spark.range(1)).select

    def turned(self, *cols):
        reads[0] += 1
        spark.conf.set(SPLITS, 1 + reads[0] % 7)
        return real(self, *cols)

    monkeypatch.setattr(type(spark.range(1)), "select", turned)
    yield
    spark.conf.unset(SPLITS)


def _many_files(spark, sample, path):
    sample.select("doc_id", "source", "lang", "text", "n_chars").limit(120).repartition(16).write.parquet(path)
    return spark.read.parquet(path)


def _rows(df):
    return Counter(map(str, df.collect()))


def test_rows_keep_their_identity(spark, sample, tmp_path, resplit, data):
    docs = _many_files(spark, sample, str(tmp_path / "t"))
    plain = {r.doc_id: r.text for r in docs.collect()}
    for r in substring_dedup(docs).collect():
        text, at, kept = plain[r.doc_id], 0, ""
        for s in r.spans or []:
            kept, at = kept + text[at : s.i], s.j
        assert r.kept_text == kept + text[at:]
    assert all(r.n_bytes == len(plain[r.doc_id].encode()) for r in remove_repeats(docs).collect())
    kept = _rows(C.near_copies(spark, docs, f"{data}/sf0.001"))
    assert set(kept.values()) == {1} and all(any(f"doc_id={i}," in r for i in plain) for r in kept)
    assert len({r.text for r in C.exact_copies(spark, docs, f"{data}/sf0.001").collect()}) == len(set(plain.values()))
    words = {i: Counter(t.split()) for i, t in plain.items()}
    for r in C.mix(spark, docs, f"{data}/sf0.001").collect():
        assert not Counter(r.text.split()) - words[r.doc_id]


def test_mix_hangs_on_ids_and_texts_alone(spark, sample, tmp_path):
    """Other files, another order, another setting: the same words are taken."""
    some = sample.select("doc_id", "source", "text").limit(90)
    some = some.unionByName(some.limit(5)).unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    got = []
    for n, partitions in ((2, 4), (7, 9)):
        some.repartition(n, F.xxhash64("text", F.lit(n))).write.parquet(f"{tmp_path}/{n}")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got.append(_rows(taken_words(mix_sources(spark.read.parquet(f"{tmp_path}/{n}"))).drop("row_id")))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and sum(got[0].values()) == 98


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, ROW_ID int")
    out, name = identified(df)
    out = out.drop("ROW_ID").withColumn("ROW_ID", F.lit(2)).select("doc_id", "text", "ROW_ID", name)
    assert name == "_row_id" and out.columns == ["doc_id", "text", "ROW_ID", "_row_id"]
    assert fresh("x", ["X", "_x"]) == "__x"


def test_heavy_join_is_a_join(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id") % 17).alias("k"), "id")
    lookup = spark.range(13).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), (F.col("id") % 5).alias("w"))
    want = _rows(rows.join(lookup.drop("w"), "k"))
    for heavy in (1, 3, 100):
        assert _rows(heavy_join(rows, lookup, "k", "w", heavy)) == want


def test_samples_are_bounded_by_rows(spark):
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same id again and again").alias("text"), F.lit("en").alias("lang"))
    some = spark.range(50).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit("de").alias("lang"))
    docs = many.unionByName(some)
    x, label, langs = L.training_windows(docs, rows=100)
    assert x.shape[1] <= 100 * L.WINDOWS and sorted(langs) == ["de", "en"] and len(set(label)) == 2
    different = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    assert L.training_windows(different, rows=100)[0].shape[1] <= 100 * L.WINDOWS
    collected = []
    real = Q.fit_ordinal
    Q.fit_ordinal = lambda i, v, row, grade, **k: collected.append(len(grade)) or real(i, v, row, grade, **k)
    try:
        Q.train(docs, docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade")).distinct(), rows=40)
    finally:
        Q.fit_ordinal = real
    assert collected == [40]


def test_many_languages_are_bounded(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    x, _, langs = L.training_windows(docs, rows=60, languages=5)
    assert langs == ["l0", "l1", "l10", "l100", "l101"] and x.shape[1] == 5 * 3 * L.WINDOWS


def test_near_copies_agree_with_and_without_numbers(spark, sample):
    docs, row = identified(sample)
    a = near_duplicates(docs, row=row).select("doc_id", "component_id", "first")
    assert _rows(a) == _rows(near_duplicates(sample).select("doc_id", "component_id", "first"))
    assert np.isfinite(a.count())


def test_numbers_of_files_hang_on_no_split_and_need_no_copy(spark, tmp_path):
    path = str(tmp_path / "some docs")
    spark.range(700).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.lit(1).alias("file_of_row")).repartition(5).write.parquet(path)
    setting, got = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(setting)
    try:
        for size in (before, "700"):
            spark.conf.set(setting, size)
            out, row = identified(spark.read.parquet(path))
            assert out.columns == ["doc_id", "text", "file_of_row", row] and all(path.replace(" ", "%20") in f for f in out.inputFiles())
            got.append({r.doc_id: r[row] for r in out.collect()})
            some = rows_among(out, row, out.where("doc_id % 3 = 1").select(F.col(row).alias("row_id")))
            assert some.columns == out.columns and sorted(r.doc_id for r in some.collect()) == list(range(1, 700, 3))
    finally:
        spark.conf.set(setting, before)
    assert got[0] == got[1] and len(set(got[0].values())) == 700
    # the same file twice, and rows that are not a file's
    for df in (spark.read.parquet(path, path), spark.read.parquet(path).where("doc_id < 9")):
        out, row = identified(df)
        assert not any("some" in f for f in out.inputFiles()) and out.select(row).distinct().count() == df.count()


def test_saved_tables_leave_no_shuffle_files(spark):
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before = files()
    counts = [spark.range(5000).groupBy((F.col("id") % (900 + i)).alias("k")).count() for i in range(3)]
    saved = [save(c.repartition(3, "count"), "counts") for c in counts]
    for _ in range(50):  # they go in the background
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and [x.count() for x in saved] == [900, 901, 902]
