import pytest

LONG = " ".join(f"word{i % 997} and then." for i in range(30_000))
#: null and empty texts, white space, equal rows, null ids, ties, a very long text, odd characters
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "b"),
    (3, " \n\t ", None, None),
    (4, "The same words twice over.", "en", "a"),
    (4, "The same words twice over.", "en", "a"),
    (5, "The same words twice over.", "de", None),
    (None, "no id at all here", "en", "a"),
    (None, None, None, None),
    (6, LONG, "en", "a"),
    (7, LONG, "en", "c"),
    (8, "naïve café — ça va? \U0001f44d\U0001f3fd ünïcode", "fr", "b"),
    (9, "12345 67890 !!", "fr", "b"),
]
#: columns whose names clash with the operators' own
CLASH = ["row_id", "digest", "n", "kept", "spans", "fp", "key", "shard", "view", "block", "start", "target", "score", "s", "at", "chunk", "length", "epoch", "stretches", "expected_grade", "tail", "keep", "sketch", "bits", "prev", "bucket", "keys", "hot", "verdicts", "dkey", "whole", "copies", "i", "j", "x", "fits", "patterns", "best", "cell", "part", "level", "known", "__row_id", "__grade", "__tail", "__keep", "__stretches", "_row_id", "rank", "cut"]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge rows as a Parquet table with clashing extra columns."""
    rows = [(*r, len(r[1] or ""), *range(len(CLASH))) for r in EDGE]
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, edge):
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(scope="session")
def sample(spark, data):
    return spark.read.parquet(f"{data}/sf0.001/documents.parquet")
