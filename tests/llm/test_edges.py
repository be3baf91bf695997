"""What the other modules leave: the registry, long pages, odd documents, workers' memory."""

import pyarrow as pa
import pytest
from llm.conftest import ODD, SMALL

import __spark_entry__ as entry
from radarlake.llm import common, op4_wrappers, op6_language
from radarlake.llm.common import attach, components, frugal


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and {"op8_license_scan", "op10_topk_search"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("page", ["<p>" * 50_000 + "x", "<div>" * 900 + "deep" + "</div>" * 900, "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<ul><li>" * 30_000 + "deep", "<p>" + "word " * 200_000, "<" * 20_000, "<a " * 5_000, "&amp;" * 50_000, "<!--" + "x" * 100_000, "<script>" + "a<b" * 50_000, "<b" + "'" * 3_001 + ">t"])
def test_long_and_broken_pages(page):
    text = op4_wrappers.main_text(page, None)
    assert text == " ".join(text.split())


def test_odd_documents_have_a_language(spark, frame):
    model = op6_language.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = op6_language.fuse(op6_language.document_rows(frame(ODD)), model)
    assert got.count() == len(ODD) and got.filter("language IS NULL OR probability IS NULL").count() == 0
    assert op6_language.fuse(op6_language.document_rows(frame([])), model).count() == 0


def test_attach_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    left = spark.createDataFrame([(k % 5 if k > 60 else 0, k) for k in range(100)], "key long, v long")
    right = left.groupBy("key").count().withColumnRenamed("count", "n").filter("key <> 3").selectExpr("key", "n", "key * 10 AS w")
    assert attach(left, right, "key", "n").count() == left.filter("key <> 3").count()
    got = attach(left, right, "key", "n", "left")
    assert got.count() == 100 and got.filter("key = 3 AND w IS NOT NULL").count() == 0 and got.filter("w = key * 10").count() == left.filter("key <> 3").count()


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (300, 249)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[200 + k] == 100 for k in range(50)) and got[300] == 100 and 0 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frugal_slices():
    seen = list(frugal(lambda bs: (pa.record_batch({"n": [b.num_rows]}) for b in bs), 4)(iter([pa.record_batch({"x": list(range(10))}), pa.record_batch({"x": pa.array([], pa.int64())})])))
    assert [b.column(0)[0].as_py() for b in seen] == [4, 4, 2]
