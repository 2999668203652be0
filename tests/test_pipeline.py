"""The pipeline, queries, scan, sinks and streams on small tables."""

import datetime
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.tables import write
from tonewright.operators import pipeline as L
from tonewright.operators import reports as R
from tonewright.operators import upkeep
from tonewright.plans import catalog
from tonewright.sources import events, scan, sinks
from tonewright.sources.library import library
from tonewright.streaming import feed

DAY = datetime.datetime(2024, 1, 1)


def _file(i, **more):
    return {"file_id": i, "file_key": f"k{i}", "src_path": f"/src/{i}.mp3", "size_bytes": 1000, "mtime_unix": 5, "status": "meta_ok", "last_update_at": DAY} | more


def _tags(i, **more):
    return {"file_id": i, "codec": "mp3", "lossless": False, "bitrate_kbps": 320, "sample_rate": 44100, "duration_ms": 125000, "tag_artist": "Artist", "tag_title": "Song", "tag_album": "Album"} | more


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    files = [_file(1), _file(1, status="error", last_update_at=DAY - datetime.timedelta(1)), _file(2, mtime_unix=4), _file(3), _file(4, error="read timeout"), _file(5), _file(6), _file(7)]
    tags = [_tags(1), _tags(1), _tags(2), _tags(3, codec="flac", lossless=True, bit_depth=24, sample_rate=96000, tag_title="Song (Live)"), _tags(4, tag_artist=None, tag_title="", tag_album="Mix"), _tags(5, tag_artist="B", tag_album="Mix"), _tags(6, tag_artist="C", tag_album="Mix"), _tags(7, tag_artist="D", tag_album="Mix")]
    return write(spark, tmp_path_factory.mktemp("small"), files=files, metadata=tags)


def test_keys(spark, small):
    got = {r.file_id: r.key for r in L.with_cluster_key(library(spark, small)).select("file_id", "key").collect()}
    assert got[1] == got[2] == "artist|song|studio|126|disc0|track0"
    assert got[3] == "artist|song|live|126|disc0|track0" and got[4] == "unknown|4|studio|126|disc0|track0"


def test_winner_is_the_older_of_equals(spark, small):
    rows = L.winners(L.with_score(L.with_cluster_key(library(spark, small)))).collect()
    assert {r.file_id for r in rows} == {2, 3, 4, 5, 6, 7}


def test_collisions_keep_the_best(spark, small):
    got = {r.file_id: (r.action, r.reason) for r in L.plans(library(spark, small)).collect()}
    assert got[1] == ("skip", "duplicate") and got[2][0] == "copy" and got[3][0] == "copy"
    with pytest.raises(ValueError):
        L.plans(library(spark, small), action="burn")


def test_compilations(spark, small):
    got = {r.file_id: r.dest_path for r in L.with_destination(library(spark, small)).select("file_id", "dest_path").collect()}
    assert got[5] == "/dest/Various Artists/Mix/B - Song.mp3" and got[1] == "/dest/Artist/Album/Song.mp3"


def test_query_and_reports(spark, small):
    lib = library(spark, small)
    assert [r.file_id for r in R.query(lib, title="SONG (").collect()] == [3]
    assert R.query(lib, lossless=True, lossy=True).count() == 0
    assert R.query(lib, sort="artist", limit=2).count() == 2
    assert [tuple(r) for r in R.top_errors(lib).collect()] == [("read timeout", 1)]
    assert "| error | n |" in R.markdown("Report", {"Errors": R.top_errors(lib)})
    tree = {r.prefix: (r.is_file, r.files) for r in R.prefixes(spark.createDataFrame([("/a/b/c.mp3",), ("/a/d.mp3",), ("",)], "dest_path string")).collect()}
    assert tree == {"a": (False, 2), "a/b": (False, 1), "a/b/c.mp3": (True, 1), "a/d.mp3": (True, 1)}
    done = spark.createDataFrame([(2, True)], "file_id long, verify_ok boolean")
    assert 2 not in {r.file_id for r in R.executed(L.plans(lib), lib, done).collect()}


def test_order_of_the_whole_library(spark, tmp_path):
    files = [{"file_id": i, "src_path": f"/a/{i * 37 % 250:03}.mp3", "status": "meta_ok"} for i in range(250)]
    metadata = [{"file_id": i, "tag_artist": f"a{i % 7}", "tag_album": f"b{i % 5}", "tag_title": f"t{i % 3}", "tag_track": i % 4, "duration_ms": i % 11, "bitrate_kbps": i % 13} for i in range(250)]
    folder = write(spark, tmp_path, files=files, metadata=metadata)
    keys = {"artist": lambda i: (i % 7, i % 5, i % 4, i), "album": lambda i: (i % 5, i % 4, i), "title": lambda i: (i % 3, i), "duration": lambda i: (-(i % 11), i), "bitrate": lambda i: (-(i % 13), i), "path": lambda i: (i * 37 % 250, i)}
    for name, key in keys.items():
        got = {r.place: r.file_id for r in catalog.queries()[f"o1_order_{name}"](spark, folder).collect()}
        assert [got[p] for p in range(1, 251)] == sorted(range(250), key=key) and len(got) == 250


def test_verification_and_doctor(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "file_id long, size_bytes long, sha1 string")
    b = spark.createDataFrame([(1, 5, "z")], "file_id long, size_bytes long, sha1 string")
    assert {tuple(r) for r in R.verified(a, b).collect()} == {(1, True), (2, False)}
    assert {r.verify_ok for r in R.verified(a, b, "hash").collect()} == {False} and {r.verify_ok for r in R.verified(a, b, "none").collect()} == {True}
    with pytest.raises(ValueError):
        R.verified(a, b, "full")
    assert R.doctor({"files": a}, {"files": ("file_id", "status"), "metadata": ("file_id",)}) == [("files", "error", "lacks status"), ("metadata", "error", "no table")]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mp3", "sub/B.FLAC", "sub/note.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = scan.discovered(spark, str(tmp_path))
    assert {r.src_path.rsplit("/", 1)[1] for r in found.collect()} == {"a.mp3", "B.FLAC"}
    known = found.where("src_path like '%a.mp3'")
    assert [r.src_path.rsplit("/", 1)[1] for r in scan.new_files(found, known).collect()] == ["B.FLAC"]


def test_file_keys_tell_equal_files_apart(spark, tmp_path):
    for name in ("a.mp3", "b.mp3"):
        (tmp_path / name).write_bytes(b"same")
        os.utime(tmp_path / name, (5, 5))
    found = scan.discovered(spark, str(tmp_path))
    assert len({r.file_key for r in found.collect()}) == 2 and scan.new_files(found, found.limit(0)).count() == 2
    stat = os.stat(tmp_path / "a.mp3")
    want = hashlib.sha1(f"{stat.st_dev}:{stat.st_ino}:4:5".encode()).hexdigest()
    assert found.where("src_path like '%a.mp3'").first().file_key == want
    assert scan.is_known(found, str(tmp_path / "a.mp3")) and not scan.is_known(found.where("src_path like '%a.mp3'"), str(tmp_path / "b.mp3")) and not scan.is_known(found, str(tmp_path / "c.mp3"))
    assert {r.sha1 for r in scan.content_hashes(spark, str(tmp_path)).collect()} == {hashlib.sha1(b"same").hexdigest()}


def test_events(spark):
    rows = spark.createDataFrame([("k", "/a", "skip", "", "duplicate"), ("l", "/b", "copy", "/d", "best quality")], "file_key string, src_path string, action string, dest_path string, reason string")
    got = {(r.event, r.level, r.src_path, r.dest_path) for r in events.plannings(rows).collect()}
    assert got == {("skip", "info", "/a", None), ("plan", "info", "/b", "/d")}
    assert events.at_least(events.plannings(rows), "warning").count() == 0 and events.at_least(events.conflicts(rows), "warning").count() == 2
    done = rows.withColumn("bytes_written", F.lit(5)).withColumn("error", F.when(F.col("action") == "skip", "lost").otherwise(""))
    assert {r.level for r in events.executions(done).collect()} == {"info", "error"}
    for wrong in (lambda: events.event(rows, "dance", "info"), lambda: events.event(rows, "scan", "loud"), lambda: events.event(rows, "scan", "info", colour=F.lit(1)), lambda: events.at_least(rows, "loud")):
        with pytest.raises(ValueError):
            wrong()


def test_upkeep(spark, small):
    lib = library(spark, small)
    assert upkeep.rescan_candidates(lib).count() == 7 and upkeep.rescan_candidates(lib, errors_only=True).count() == 0
    tags = spark.createDataFrame([(1, "A", ""), (2, "B", "T")], "file_id long, tag_artist string, tag_title string")
    probe = spark.createDataFrame([(1, "X", "P", "flac", True), (3, "Y", "Q", "mp3", False)], "file_id long, tag_artist string, tag_title string, codec string, lossless boolean").withColumns({k: F.lit(1) for k in ("duration_ms", "sample_rate", "bit_depth", "bitrate_kbps", "channels")} | {"container": F.lit("c")})
    got = {r.file_id: (r.tag_artist, r.tag_title, r.codec) for r in upkeep.reread(tags, probe).collect()}
    assert got == {1: ("A", "", "flac"), 2: ("B", "T", None), 3: ("Y", "Q", "mp3")}
    plans = L.plans(lib)
    ran = R.executed(plans, lib.withColumn("status", F.when(F.col("error") != "", "error").otherwise(F.col("status"))))
    text = upkeep.report(lib, plans, ran, {"Top errors": R.top_errors(lib), "Nothing": lib.limit(0)})
    assert "## Overview" in text and "- **Files valid**: 7" in text and "- **Files failed**: 1" in text and "| read timeout | 1 |" in text and "## Nothing" not in text
    assert [tuple(r) for r in upkeep.first_errors(ran, 0).collect()] == [] and upkeep.first_errors(ran, 5).first().more == 0
    members = lib.select(F.lit("k").alias("cluster_key"), "file_id")
    assert not upkeep.stale(lib, members) and upkeep.stale(lib.withColumn("last_update_at", F.when(F.col("file_id") > 3, F.lit(DAY + datetime.timedelta(1))).otherwise(F.lit(DAY))), members)
    assert [r.name for r in upkeep.children(spark.createDataFrame([("a/b.mp3", True), ("a/Z", False), ("a/c", False), ("a", False)], "prefix string, is_file boolean")).where("parent = 'a'").orderBy("place").collect()] == ["c", "Z", "b.mp3"]


def test_conditions_reach_the_scan(spark, small):
    plan = R.query_library(spark, small, album="Mix")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag_album,Mix)" in plan
    assert {r.file_id for r in R.query_library(spark, small, album="Mix").collect()} == {4, 5, 6, 7} and {r.file_id for r in R.query_library(spark, small, empty_artist=True).collect()} == {4}


def test_hot_key_and_empty_albums(spark, tmp_path):
    files = [_file(i, src_path=f"/src/{i:04}.mp3") for i in range(600)]
    tags = [_tags(i, tag_album="" if i % 3 else "Album", tag_title="Hot" if i % 3 else f"T{i}", bitrate_kbps=128 + i % 300) for i in range(600)]
    rows = L.plans(library(spark, write(spark, tmp_path, files=files, metadata=tags))).collect()
    kept = {r.file_id for r in rows if r.action == "copy"}
    assert len(rows) == 600 and len(kept) == 201 and len([i for i in kept if i % 3]) == 1


def test_probe_and_merge(spark):
    probe = {"streams": [{"codec_type": "video", "codec_name": "png"}, {"codec_type": "audio", "codec_name": "flac", "sample_rate": "96000", "channels": 2, "bits_per_sample": "N/A", "bits_per_raw_sample": "24"}], "format": {"format_name": "flac", "duration": "12.5", "bit_rate": "900500", "tags": {"ARTIST": "A", "track": "3/10"}}}
    p = scan.probed(spark.createDataFrame([(1, json.dumps(probe)), (2, "{")], "file_id long, probe string"))
    r = p.where("file_id = 1").first()
    assert (r.codec, r.sample_rate, r.bit_depth, r.duration_ms, r.bitrate_kbps, r.lossless, r.tag_artist, r.tag_track) == ("flac", 96000, 24, 12500, 900, True, "A", 3)
    tags = spark.createDataFrame([(1, "B", "", "T", "", "", 0, 2)], "file_id long, tag_artist string, tag_album string, tag_title string, tag_albumartist string, tag_date string, tag_track int, tag_disc int")
    m = scan.merged(tags, p).where("file_id = 1").first()
    assert (m.tag_artist, m.tag_title, m.tag_track, m.tag_disc) == ("B", "T", 3, 2)


def test_sinks(spark, tmp_path, small):
    old = spark.createDataFrame([("a", 1, "new"), ("b", 2, "done")], "k string, size int, status string")
    new = spark.createDataFrame([("b", 3, "new"), ("c", 4, "new")], "k string, size int, status string")
    path = str(tmp_path / "t")
    sinks.replace_table(old, path)
    sinks.replace_table(sinks.upserted(spark.read.parquet(path), new, "k", keep=("status",)), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1, "new"), ("b", 3, "done"), ("c", 4, "new")]
    sinks.replace_table(spark.read.parquet(path).where("k <> 'a'"), path)
    assert spark.read.parquet(path).count() == 2 and not list(tmp_path.glob("t.*"))
    upkeep.cleared(spark, path)
    assert spark.read.parquet(path).count() == 0
    log = spark.createDataFrame([("debug", "x", ""), ("error", "y", "z")], "level string, event string, error string")
    sinks.append_events(log, str(tmp_path / "log"), "warning")
    assert [r.event for r in sinks.read_events(spark, str(tmp_path / "log")).collect()] == ["y"]
    sinks.export_csv(library(spark, small), str(tmp_path / "csv"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert csv.count() == 7 and csv.columns == ["path", "artist", "album", "title", "track", "disc", "format", "codec", "bitrate_kbps", "duration_ms", "lossless", "size_bytes"]
    sinks.export_jsonl(library(spark, small), str(tmp_path / "jsonl"))
    lines = spark.read.json(str(tmp_path / "jsonl"))
    assert lines.count() == 7 and len(lines.columns) == 13
    lib = library(spark, small)
    assert lib.where("file_id = 1").select(sinks.writer_arguments({c: F.col(c) for c in lib.columns}).alias("a")).first().a[:2] == ["-metadata", "artist=Artist"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"event_id": i, "ts": f"2024-01-01T0{i}:00:00", "event_type": "view", "value": 1.0}) for i in range(5)))
    feed.drain(feed.windowed_counts(feed.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}


def test_names_of_queries_and_sql():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, tmp_path_factory, name):
    global _empty
    if "_empty" not in globals():
        _empty = write(spark, tmp_path_factory.mktemp("none"))
    catalog.queries()[name](spark, _empty).collect()
