import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def llm(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # so that work goes on across batches; queries set their own
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def odd_docs(llm):
    """Nulls, empty and long texts, ties, repeated rows, other white space, clashing extra columns."""
    long = " ".join(f"w{k % 700}x{k}" for k in range(30000))
    base = " ".join(f"word{k}" for k in range(80))
    texts = [
        (1, base), (2, base + " more"), (2, base + " more"), (3, base.upper().replace(" ", "\t\n")), (4, None), (None, base),
        (None, None), (5, ""), (6, "  \n "), (7, "Ünï cödé text"), (8, "a b"), (9, "A  B"), (10, long), (11, "!!! 123"),
        (12, "x" * 50000), (13, "la la la la la la"), (14, "\x1c\x01  odd\x85 spaces"),
    ]
    rows = [(i, t, "en", None if i == 8 else f"s{k}", 1, 5, "c", True, 7) for k, (i, t) in enumerate(texts)]
    return llm.createDataFrame(rows, SCHEMA + ", node int, label string, kept boolean, n_words int")


@pytest.fixture
def no_docs(llm):
    return llm.createDataFrame([], T._parse_datatype_string(SCHEMA))
