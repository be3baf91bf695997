import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents():
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) pairs, with clashing extra columns."""

    def make(rows):
        schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("id", T.StringType()), ("rid", T.LongType()), ("n", T.IntegerType()), ("key", T.StringType()))])
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", 7, 1, None) for i, t in rows], schema)

    return make


#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [(None, "no id here"), (1, None), (2, ""), (3, "   \n\t "), (4, "a" * 70_000), (5, "word " * 20_000), (6, "same row"), (6, "same row"), (7, "same row"), (8, "ÉÈ ß\u00a0ñ \u2003x"), (9, "one"), (10, "\x00 \x1f nul")]
