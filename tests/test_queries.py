"""Every catalogue query against its SQL, or, without one, against brute force."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skerry.plans import catalogue
from skerry.plans.search_queries import MISSPELT
from skerry.streaming import rollup

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def plain_discovery(events):
    """The states of all keys after their events, one key after the other, with retries released by the last hour but one."""
    end = max(ts for _, _, ts, _ in events) - 3600
    states = {}
    for ih, kind, ts, _ in sorted(events, key=lambda e: (e[0], e[2], e[3])):
        states[ih] = rollup.step(states.get(ih), kind, ts, rollup.REVIVE_S)
    return {ih: rollup.release(s) if s["status"] == "retry" and s["retry_at"] <= end else s for ih, s in states.items()}


def test_stream_of_discovery_is_the_plain_fold(spark, small):
    names = {"view": "seen", "click": "probe", "purchase": "peer", "error": "fail", "signup": "announce"}
    events = []
    for r in spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id", "user_id", "event_type", "unix_seconds(cast(ts as timestamp)) t").collect():
        events.append((r.user_id, "ok" if r.event_type == "purchase" and r.event_id % 20 == 0 else names[r.event_type], r.t, r.event_id))
    want = plain_discovery(events)
    got = {r.ih: r.asDict() for r in QUERIES["stream_discovery"](spark, small).collect()}
    assert {ih: {k: v for k, v in row.items() if k != "ih"} for ih, row in got.items()} == want
    assert {s["status"] for s in want.values()} & {"failed", "pending", "retry"}


def plain_suggestions(spark, small):
    """did-you-mean over all words of all names, as the rule says it."""
    import difflib

    from skerry.functions.text import index_tokens
    from skerry.plans.views import docs

    d = docs(spark, small).select("deleted", "hidden", index_tokens(F.col("name")).alias("n"), index_tokens(F.col("body")).alias("f")).collect()
    names, visible, every = Counter(t for r in d for t in r.n), {t for r in d if not r.deleted and not r.hidden for t in r.n}, {t for r in d for t in (*r.n, *r.f)}
    out = {}
    for w in MISSPELT:
        if any(t.startswith(w) for t in every):
            continue
        near = [t for t in names if t[0] == w[0] and abs(len(t) - len(w)) <= 2]
        best = [t for t in difflib.get_close_matches(w, near, n=3, cutoff=0.75) if t in visible]
        if best:
            out[w] = max(best, key=lambda t: names[t])
    return out


def test_did_you_mean_is_brute_force(spark, small):
    got = {r.word: r.suggestion for r in QUERIES["search_did_you_mean"](spark, small).collect()}
    assert got and got == plain_suggestions(spark, small)


def test_sketch_is_near_the_exact_count(spark, small):
    exact = spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()
    assert abs(QUERIES["distinct_sketch"](spark, small).first().n - exact) <= 0.03 * exact


def test_every_query_has_sql_or_a_test_of_its_own():
    """stream_queues is held against plain lists in test_streams.py, the others above."""
    assert set(QUERIES) - set(SQL) == {"stream_discovery", "stream_queues", "search_did_you_mean", "distinct_sketch"}


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_package(tmp_path):
    """With its folders gone, with and without the pipeline, the catalogue's queries are all there."""
    root = Path(__file__).resolve().parent.parent
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
        run = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert run.returncode == 0 and int(run.stdout) == len(QUERIES), run.stderr


def test_a_range_of_many_points_is_its_sql(spark, tmp_path):
    """More points than an answer has: means of several, as the SQL rounds them."""
    import duckdb

    points = spark.range(3000).selectExpr("id event_id", "id % 7 user_id", "'view' event_type", "timestamp_seconds(1700000000 + id * 50) ts", "id * 37 % 1000 / 7D value")
    points.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT t, gauge, counter FROM ({SQL['metrics_range']})").fetchall()
    got = [tuple(r) for r in QUERIES["metrics_range"](spark, str(tmp_path)).select("t", "gauge", "counter").collect()]
    assert sorted(got) == sorted(want) and any(round(g, 1) != g for _, g, _ in want)


def test_searches_without_words_make_no_index(spark, small, monkeypatch):
    from skerry.plans import search_queries

    def made(*_):
        raise AssertionError("an index was made")

    monkeypatch.setattr(search_queries, "stored", made)
    for name in ("search_category_not_in", "search_category_in", "search_numeric_ranges", "search_age_range", "search_health_state", "search_key_prefix"):
        QUERIES[name](spark, small)


def test_postings_of_many_mixed_tokens_take_time_in_proportion(spark):
    """Runs of digits are cut out of all tokens at once, not in a pass over the batch for each token."""
    import random
    import time

    import pyarrow as pa

    from skerry.operators import postings as P

    rng = random.Random(1)
    lists = pa.array([["".join(rng.choices("abc123456", k=8)) for _ in range(20)] + ["the", "of"] * 150 for _ in range(2000)], pa.list_(pa.string()))
    ids, started = pa.array(range(2000), pa.int64()), time.monotonic()
    whole = P.located(ids, lists, "f")
    assert time.monotonic() - started < 5
    pieces = list(P.in_pieces(lists, 50_000))
    assert len(pieces) > 10 and sum(n for _, n in pieces) == 2000
    rows = sorted((r["doc_id"], r["token"], r["at"]) for p in pieces for r in P.located(ids.slice(*p), lists.slice(*p), "f").to_pylist())
    assert rows == sorted((r["doc_id"], r["token"], r["at"]) for r in whole.to_pylist())


def test_postings_of_a_few_file_words_are_those_of_the_index(spark):
    from skerry.operators import search as S

    files = "doc_id long, files array<struct<path:string,size:long>>"
    items = spark.createDataFrame([(1, [("a/small.ring", 1), ("ring.small", 2)]), (2, [("Small/x12345", 1)]), (3, []), (4, [("s", 1)])], files)
    rows = lambda f: sorted((r.doc_id, r.token, list(r.at)) for r in f.select("doc_id", "token", "at").collect())
    asked = ["small", "ring", "s", "small"]
    got = rows(S.file_postings_of(items, asked))
    assert got and got == rows(S.file_postings(items).filter((F.col("field") == "f") & F.col("token").isin(asked)))
    assert rows(S.file_postings_of(items, ["s"])) == []


def test_file_queries_run_no_python(spark, small):
    for name in ("search_phrase_in_files", "search_extension_not_in"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan
