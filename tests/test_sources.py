"""Sources and sinks on files in a temporary folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.sources import files as S

SCHEMA = T.StructType([T.StructField("ih", T.StringType()), T.StructField("seq", T.LongType())])


def test_json_lines_skip_what_is_corrupt(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ih":"a","seq":1}\nnot json\n{"ih":"b","seq":2}\n')
    good, bad = S.json_lines(spark, str(tmp_path / "a.jsonl"), SCHEMA)
    assert sorted(r.ih for r in good.collect()) == ["a", "b"] and bad.count() == 1
    none, _ = S.json_lines(spark, str(tmp_path / "missing"), SCHEMA)
    assert none.count() == 0


def test_patterns_and_trackers(spark, tmp_path):
    (tmp_path / "p").write_text("# all\nudp://a:1\n ftp://b\nudp://a:1 # again\n\nhttps://c\n")
    assert sorted(r.pattern for r in S.patterns(spark, str(tmp_path / "p")).collect()) == ["ftp://b", "https://c", "udp://a:1"]
    assert sorted(r.pattern for r in S.trackers(spark, str(tmp_path / "p")).collect()) == ["https://c", "udp://a:1"]


def test_compaction_and_export(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "x")], "ih string, seq long, category string")
    kept = S.compact(spark, events, "ih", "seq", str(tmp_path / "snap"))
    assert sorted((r.ih, r.seq) for r in kept.collect()) == [("a", 3), ("b", 2)]
    again = S.compact(spark, spark.createDataFrame([("b", 9, "z"), ("c", 1, "z")], "ih string, seq long, category string"), "ih", "seq", str(tmp_path / "snap"))
    assert sorted((r.ih, r.seq) for r in again.collect()) == [("a", 3), ("b", 9), ("c", 1)]
    assert sorted((r.ih, r.seq) for r in kept.collect()) == [("a", 3), ("b", 2)]  # the older version is still whole
    (tmp_path / "snap" / "version=3").mkdir()  # a job that died
    assert S.versions(spark, str(tmp_path / "snap")) == [1, 2] and S.snapshot(spark, str(tmp_path / "none")) is None
    S.export(kept, str(tmp_path / "out"), {"x": "z"})
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"ih":"a","seq":3,"category":"y"}', '{"ih":"b","seq":2,"category":"z"}']
    assert S.storage_report(spark, str(tmp_path / "out")).agg(F.sum("bytes")).first()[0] > 0


def test_generations_are_in_numeric_order(spark, tmp_path):
    for gen, seq in ((2, 5), (10, 1)):
        (tmp_path / f"health-{gen}.wal").write_text(f'{{"ih":"a","seq":{seq}}}\n')
    rows = S.log_files(spark, str(tmp_path), SCHEMA)
    assert S.last_per_key(rows, "ih", "gen").first().seq == 1


def test_retention_by_day(spark, tmp_path):
    points = spark.createDataFrame([(86_400 * d + 5,) for d in range(5)], "t long")
    S.write_by_day(points, str(tmp_path / "tier"))
    assert S.keep_days(spark, str(tmp_path / "tier"), 3).count() == 2


def test_compact_peers(spark):
    blob = bytes([198, 18, 0, 1, 4, 0, 198, 18, 0, 2, 0, 0])
    rows = spark.createDataFrame([(blob,), (b"",)], "b binary").select(S.compact_peers(F.col("b")).alias("p")).collect()
    assert [[(x.ip, x.port) for x in r.p] for r in rows] == [[(3323068417, 1024)], []]


def test_compact_peers_of_version_six(spark):
    one = bytes(range(16)) + b"\x1a\xe1"
    rows = spark.createDataFrame([(one + bytes(18) + b"rest",)], "b binary").select(S.compact_peers(F.col("b"), 6).alias("p")).first().p
    assert [(bytes(x.ip), x.port) for x in rows] == [(bytes(range(16)), 6881)]


def test_whole_files_that_are_broken_go_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ih":"a",\n"seq":1}')
    (tmp_path / "in" / "b.json").write_text("{broken")
    good = S.whole_json(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "aside"))
    assert [(r.ih, r.seq) for r in good.collect()] == [("a", 1)]
    assert "broken" in spark.read.text(str(tmp_path / "aside")).first().value


def test_placed_lines_and_journals(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"t":"n","ih":"a","r":{"name":"x","category":"Otros"}}\nbad\n{"t":"d","ih":"a"}\n{"t":"n","ih":"a","r":{"name":"y"}}\n')
    rows = S.journal(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()
    assert [(r.t, r.name) for r in rows] == [("n", "x"), ("d", None), ("n", "y")]
    (tmp_path / "old.json").write_text('{"a":{"name":"x","category":"Otros"},\n"b":{"name":"y"}}')
    assert sorted((r.t, r.ih, r.name) for r in S.journal(spark, str(tmp_path / "old.json"), whole=True).collect()) == [("n", "a", "x"), ("n", "b", "y")]


def test_work_folder_needs_the_setting_on_a_cluster(spark, monkeypatch):
    import pytest

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master, getCheckpointDir = "yarn", staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        S.work_folder(Elsewhere, "x")
