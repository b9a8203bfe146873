import pytest

SF = "/root/testdata/sf0.001"

#: Names that operators use inside; as extra input columns they must not disturb.
CLASHING = ["d", "h", "anchor", "span", "marks", "kept", "score", "class", "row_id", "own_doc_id", "own_text", "quality", "n", "start", "length"]


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls, empty texts, repeated rows, a long text, ties, and extra columns with clashing names."""
    words = [f"w{i % 97}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(words)), (None, " ".join(words)), (3, None), (4, ""), (None, None), (5, " \n\t "), (6, "one"), (7, "ONE"), (8, "ß é \U0001f600 " * 40), (9, "a " * 30000), (10, "tail")]
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHING)) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
