import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def make(spark: SparkSession):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    def build(rows, partitions: int = 3) -> DataFrame:
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (None, "one two"), (5, "One two"), (5, "One two"), (6, "ONE TWO"),
       (7, "long " * 30_000), (8, "\u00e9 \U0001f600 x\u00a0y"), (9, "a\x0bb\x1cc\x00d")]


@pytest.fixture()
def odd(make):
    """Nulls, blanks, repeated rows and ids, ties, a very long text and odd characters."""
    return make(ODD)


@pytest.fixture()
def none(make):
    return make(ODD).where("false")
