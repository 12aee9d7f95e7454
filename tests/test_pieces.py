"""Batches in pieces: what Python makes at once doesn't grow with the batch."""

import pyarrow as pa

from skerry.functions import bencode as B
from skerry.functions.arrow import pieces


def test_pieces_are_small_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 1000)], names=["t"])
    got = list(pieces(batch, 10_000))
    assert sum(p.num_rows for p in got) == 1000 and max(p.num_rows for p in got) <= 10
    assert [p.num_rows for p in pieces(batch, 1)] == [1] * 1000
    assert list(pieces(batch.slice(0, 0))) == []


def test_bencode_over_nulls_and_errors(spark):
    rows = spark.createDataFrame([(1, b"i5e"), (2, None), (3, b"i5")], "k long, b binary").withColumn("d", B.decoded("b"))
    got = {r.k: (r.json, r.bad_at, r.again) for r in rows.select("k", "d.json", "d.bad_at", B.encoded("d.json").alias("again")).collect()}
    assert got[1] == ("5", None, b"i5e") and got[2] == (None, None, None) and got[3][0] is None and got[3][1] is not None


def test_highlight_asks_python_once(spark, small):
    from skerry.plans.search_queries import search_highlight

    plan = search_highlight(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
