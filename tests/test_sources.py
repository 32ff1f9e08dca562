import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import jdbc, mapping, snapshots
from tidemark.sources.paged import PagedSource


@pytest.fixture
def paged(spark):
    spark.dataSource.register(PagedSource)
    return lambda **o: spark.read.format("paged").options(service="tests.paged_service:CATALOGUE", stream="papers", **o)


def test_paged_source(paged):
    assert paged().load().count() == 12
    df = paged(cursor="updated_at", after="2024-02-02").load()
    assert sorted(r.id for r in df.collect()) == [12, 13, 20, 21, 22, 23]
    assert paged().load().schema.simpleString() == "struct<id:bigint,title:string,updated_at:string>"


def test_paged_stream(spark, paged, tmp_path):
    s = spark.readStream.format("paged").options(service="tests.paged_service:CATALOGUE", stream="papers").load()
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_mapping(spark):
    df = spark.createDataFrame([(1, " A ", "1700000000", "x"), (2, None, "2024-03-01T12:00:00+02:00", "y"), (3, "b", "someday", None)], "id long, n string, t string, extra string")
    out = mapping.map_fields(df, {"key": {"source": "id", "required": True}, "name": {"source": "n", "transform": "strip", "default": "none"}, "time": {"source": "t", "transform": "iso_time"}, "gone": {"default": "d"}})
    assert [tuple(r) for r in out.orderBy("key").collect()] == [(1, "A", "2023-11-14T22:13:20Z", "d", "x"), (2, "none", "2024-03-01T10:00:00Z", "d", "y"), (3, "b", "someday", "d", None)]
    assert out.columns[-1] == "_raw_extra"
    with pytest.raises(Exception, match="is missing"):
        mapping.map_fields(df, {"e": {"source": "extra", "required": True}}).collect()
    good, bad = mapping.sync(df, {"id": {}, "n": {}}, F.length("n") > 1)
    assert (good.count(), bad.count()) == (1, 2)


def test_changes(spark, tmp_path):
    schema = "seq long, id long, op string, v string"
    log = str(tmp_path / "log")
    snapshots.append_changes(spark.createDataFrame([(1, 1, "I", "a"), (2, 2, "I", "b")], schema), log)
    snapshots.append_changes(spark.createDataFrame([(3, 1, "U", "c"), (4, 2, "D", None), (5, 3, "I", "d")], schema), log)
    state = snapshots.compact(spark, log, str(tmp_path / "state"), schema, "id", ["seq"])
    assert sorted((r.id, r.v) for r in state.collect()) == [(1, "c"), (3, "d")]


def test_snapshot_round_trip_and_damage(spark, tmp_path):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "i long, s string"), spark.range(3).withColumnRenamed("id", "k")
    path = str(tmp_path / "snap")
    m = {r.collection: r for r in snapshots.save_snapshot({"a": a, "b": b}, path).collect()}
    assert (m["a"].rows, m["b"].rows) == (2, 3)
    got = snapshots.load_snapshot(spark, path, {"a": "i long, s string", "b": "k long"})
    assert sorted(map(tuple, got["a"].collect())) == [(1, None), (2, "x")]
    part = next(p for p in (tmp_path / "snap" / "a").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    part.write_text(part.read_text().replace('"i"', '"j"'))
    for crc in (tmp_path / "snap" / "a").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="manifest"):
        snapshots.load_snapshot(spark, path, {"a": "i long, s string"})


def test_json_and_json_ld(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"entities": [{"id": "a", "n": 1}, {"id": "b", "n": 2}], "triples": []}))
    assert snapshots.import_json(spark, str(tmp_path / "d.json"), "entities").count() == 2
    e = spark.createDataFrame([("u:1", "Thing", "x", 0.5)], "id string, kind string, name string, w double")
    snapshots.export_json_ld(e, "id", "kind", str(tmp_path / "ld"))
    back = snapshots.import_json_ld(spark, str(tmp_path / "ld"), "@id string, @type string, name string, w double")
    assert [tuple(r) for r in back.collect()] == [("u:1", "Thing", "x", 0.5)]
    (tmp_path / "g.txt").write_text(json.dumps({"@graph": [{"@id": "p"}, {"@id": "q", "name": "n"}]}))
    assert snapshots.import_json_ld(spark, str(tmp_path / "g.txt"), "@id string, name string").count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a\"b", 1.5)], "k string, v double")
    assert snapshots.prometheus(df, "m", ["k"], "v").first()[0] == 'm{k="a\\"b"} 1.5'
    snapshots.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).count() == 1
    (tmp_path / "f.txt").write_text("one\ntwo\n")
    assert [(r.line, r.content) for r in snapshots.read_lines(spark, str(tmp_path / "f.txt")).orderBy("line").collect()] == [(1, "one"), (2, "two")]


def test_jdbc_names(spark):
    with pytest.raises(ValueError):
        jdbc.read_table(spark, "jdbc:x", "t; drop table t")


def test_iso_time_epoch(spark):
    got = spark.createDataFrame([("0",)], "t string").select(mapping.iso_time(F.col("t"))).first()[0]
    assert got == datetime.datetime(1970, 1, 1).isoformat() + "Z"


def test_iso_time_in_any_session_zone(spark):
    rows = [("0", "1970-01-01T00:00:00Z"), ("-1", "1969-12-31T23:59:59Z"), ("1700000000.5", "2023-11-14T22:13:20Z"), ("2024-03-10T02:30:00+09:00", "2024-03-09T17:30:00Z"), ("2024-03-10 02:30:00", "2024-03-10T02:30:00Z"), ("2024-03-10T02:30:00", "2024-03-10T02:30:00Z"), ("2024-03-10", "2024-03-10T00:00:00Z"), ("10/03/2024", "2024-03-10T00:00:00Z"), ("2024-03", "2024-03-01T00:00:00Z"), ("soon", "soon"), (None, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = spark.createDataFrame(rows, "t string, want string").select(mapping.iso_time(F.col("t")).alias("got"), "want").collect()
            assert [r.got for r in got] == [r.want for r in got], z
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_plan_modules_import_alone():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(mapping.__file__).parents[2]
    for name in sorted(p.stem for p in (root / "tidemark" / "plans").glob("*.py") if p.stem != "__init__"):
        done = subprocess.run([sys.executable, "-c", f"import tidemark.plans.{name}"], cwd=root, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
