import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of texts (or rows), ids from 0."""

    def make(rows, lang="en", source="a"):
        full = [(i, t, lang, source, None if t is None else len(t)) if t is None or isinstance(t, str) else t for i, t in enumerate(rows)]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest table, with rows that try the edges: nulls, empty and repeated texts, a long one, clashing extra columns."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    top = base.agg(F.max("doc_id")).first()[0]
    text = base.orderBy("doc_id").first().text
    extra = [(top + 1, None, None, None, None), (top + 2, "", "en", None, 0), (top + 3, text, "en", "src0", len(text)), (top + 4, text + " end", None, "src0", None), (top + 5, " \t\n ", "en", "src1", 4), (top + 6, "x y z " * 30_000, "en", "src1", None), (top + 7, "naïve — “quote” 漢字 語", "zz", "src1", None)]
    return base.unionByName(spark.createDataFrame(extra, COLUMNS)).withColumns({"size": F.lit("clash"), "n": F.lit(1), "sid": F.lit("s"), "line": F.lit(2), "key": F.lit(0.5), "component": F.lit(1)})
