"""Streams give what batches give: smoothing, sessions, the message log, points of line protocol, survey windows."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wavefix.operators import kalman, survey
from wavefix.sources import layout, line_protocol, log, readings
from wavefix.streaming import live
from wavefix.streaming import survey as collection


def test_stream_equals_batch(spark, tmp_path):
    msgs = readings.messages(spark, DATA)
    msgs.orderBy("event_id").coalesce(1).write.json(str(tmp_path / "in"))
    stream = live.tracked(live.readings(live.messages(spark, str(tmp_path / "in"))))
    live.into(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["event_id"]: r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = readings.parsed(msgs).withColumn("beacon", F.col("device").cast("long")).join(layout.anchors(layout.read(spark)).select("anchor_id", "anchor_idx"), "anchor_id")
    want = {r["event_id"]: r["x"] for r in kalman.smoothed(rows).collect()}
    assert got.keys() == want.keys() and len(got) > 500
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_visits_are_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, "a", at(0)), (1, "a", at(4)), (1, "a", at(8)), (1, "a", at(14)), (1, "b", at(2)), (2, "a", at(1)), (9, "z", at(100)), (9, "z", at(101))]
    schema = "beacon long, label string, ts timestamp"
    for i, part in enumerate([rows[:5], rows[5:7], rows[7:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    live.into(live.visits(s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["beacon"], r["label"], r["start"], r["end"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # Nothing ends the last session: the watermark stays behind it.
    assert got == {(1, "a", at(0), at(13), 3), (1, "a", at(14), at(19), 1), (1, "b", at(2), at(7), 1), (2, "a", at(1), at(6), 1)}


# The message log


def append(path, part, base, lines, end="\n"):
    folder = path / f"part={part}"
    folder.mkdir(parents=True, exist_ok=True)
    with (folder / f"{base:020d}.jsonl").open("a") as f:
        f.write("\n".join(lines) + end)


def message(i):
    return json.dumps({"event_id": i, "topic": f"espresense/devices/{i % 3}/a", "payload": '{"rssi": -60}', "t": float(i)})


def test_log_restarts_without_loss_or_repeats(spark, tmp_path):
    at = tmp_path / "log"
    append(at, 0, 0, [message(i) for i in range(25)])
    append(at, 1, 0, [message(i) for i in range(100, 107)] + ["not json", '{"topic": 3}', "[1]"])

    def run():
        q = live.into(log.messages(spark, str(at), rowsPerTask="4"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
        return q

    q = run()
    assert log.malformed(q) == 3
    append(at, 0, 25, [message(i) for i in range(25, 31)])  # the next segment
    append(at, 1, 0, [message(107)], end="\n" + message(108)[:20])  # a line still being written
    assert log.malformed(run()) == 0
    append(at, 1, 0, [message(108)[20:]])
    run()
    got = Counter(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == Counter([*range(31), *range(100, 109)])
    # A batch whose commit is lost reads the same offsets again.
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "ck" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    append(at, 0, 25, [message(31)])
    run()
    run()
    got = Counter(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == Counter([*range(32), *range(100, 109)])


def test_log_from_its_end_and_without_numbers(spark, tmp_path):
    reader = log.LogReader(str(tmp_path / "log"), 10, latest=True)
    assert reader.initialOffset() == {}
    append(tmp_path / "log", 2, 0, [json.dumps({"topic": "a", "payload": "b"})] * 3)
    assert reader.initialOffset() == {"2": 3} and reader.partitions({"2": 3}, {"2": 3}) == []
    assert [(p.first, p.end) for p in log.LogReader("x", 2, False).partitions({}, {"2": 3})] == [(0, 2), (2, 3)]
    q = live.into(log.messages(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(2 << 48) + i for i in range(3)]


# Points of line protocol


def test_points_once_for_each_batch(spark, tmp_path):
    rows = [(1, "a 1", 1.5, -60.0), (2, "b,=", 2.0, -70.25)]
    spark.createDataFrame(rows, "beacon long, anchor_id string, t double, rssi double").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        s = spark.readStream.schema("beacon long, anchor_id string, t double, rssi double").parquet(str(tmp_path / "in"))
        line_protocol.into(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return sorted(r["line"] for r in line_protocol.lines(spark, str(tmp_path / "out")).collect())

    want = ["rssi,beacon=1,anchor_id=a\\ 1 rssi=-60.0 1500000000", "rssi,beacon=2,anchor_id=b\\,\\= rssi=-70.25 2000000000"]
    assert run() == want
    (tmp_path / "ck" / "commits" / "0").unlink()
    (tmp_path / "ck" / "commits" / ".0.crc").unlink(missing_ok=True)
    assert run() == want
    assert not list((tmp_path / "out" / "_pending").iterdir())


def test_aborted_batches_leave_nothing(tmp_path):
    from pyspark.sql import Row

    writer = line_protocol.LineWriter(str(tmp_path), "rssi", ["a"], "t", 2, 0.0)
    done = writer.write(iter([Row(a="x", t=1.0, v=1.0)]))

    def broken():
        yield Row(a="x", t=1.0, v=1.0)
        raise RuntimeError("task lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    writer.abort([done, None], 0)
    assert not list((tmp_path / "_pending").iterdir()) and not (tmp_path / "batch=0").exists()
    again = writer.write(iter([Row(a="x", t=1.0, v=1.0)]))
    writer.commit([again], 0)
    writer.commit([again], 0)  # a commit that is tried again
    assert sum(1 for _ in (tmp_path / "batch=0").glob("*.lp")) == 1


def test_writes_are_tried_again():
    calls = []

    def fails(n):
        def act():
            calls.append(1)
            if len(calls) < n:
                raise OSError("busy")

        return act

    line_protocol.again(fails(3), 3, 0.0)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        line_protocol.again(fails(9), 2, 0.0)


def test_points_without_fields(tmp_path):
    assert line_protocol.point({"t": 1.0, "a": "x", "v": None}, "m", ["a"], "t") is None
    assert line_protocol.point({"t": None, "v": 1.0}, "m", [], "t") is None
    assert line_protocol.point({"t": 1.0, "a": None, "n": 3, "b": True, "s": 'q"'}, "m", ["a"], "t") == 'm n=3i,b=true,s="q\\"" 1000000000'


# Survey windows

EVENT = "beacon long, t double, point_id long, pass string, anchor_idx int, rssi double"


def test_survey_stream_equals_aggregated(spark, tmp_path):
    """Points of the driver's readings, each in a window of its own; readings between windows belong to none."""
    s = readings.readings(spark, DATA).select("event_id", F.floor(F.col("event_id") / 40).alias("p"), "anchor_idx", "rssi")
    at = (F.col("p") + 10) * 100 + (F.col("event_id") % 40) * 0.5
    sent = s.select(F.lit(1).cast("long").alias("beacon"), at.alias("t"), F.lit(None).cast("long").alias("point_id"), F.lit(None).cast("string").alias("pass"), "anchor_idx", "rssi")
    stray = s.select(F.lit(1).cast("long"), ((F.col("p") + 10) * 100 + 50).cast("double"), F.lit(None).cast("long"), F.lit(None).cast("string"), "anchor_idx", F.lit(0.0))
    markers = s.select(F.lit(1).cast("long"), ((F.col("p") + 10) * 100).cast("double"), "p", F.lit("normal"), F.lit(None).cast("int"), F.lit(None).cast("double")).distinct()
    end = spark.createDataFrame([(1, 1e6, None, None, 0, -50.0)], EVENT)
    rows = sent.union(markers).union(stray).union(end).withColumn("n", F.floor(F.col("t") / 700)).orderBy("t").collect()
    for n in sorted({r["n"] for r in rows}):
        spark.createDataFrame([tuple(r)[:6] for r in rows if r["n"] == n], EVENT).coalesce(1).write.json(str(tmp_path / "in" / f"n={n:04d}"))
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    collection.into(events, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = survey.aggregated(s.select(F.col("p").alias("point_id"), "anchor_idx", "rssi"))
    cols = ["point_id", "anchor_idx", "mean", "std", "n", "anchor_count", "n_readings", "high_var", "rejected"]
    kept = spark.read.parquet(str(tmp_path / "out" / "fingerprints"))
    got = kept.select(cols).union(spark.read.schema(kept.schema).parquet(str(tmp_path / "out" / "rejected")).select(cols))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(cols).collect()))


def test_survey_resumes_with_redo_and_occluded_pass(spark):
    points = spark.createDataFrame([(1, "grid"), (2, "poi"), (3, "poi")], "point_id long, kind string")
    log_ = spark.createDataFrame([(1, "normal", 1.0, 1, True), (2, "normal", 2.0, 2, True), (2, "occluded", 9.0, 9, True), (3, "normal", 3.0, 3, True), (3, "normal", 3.0, 4, False)], "point_id long, pass string, t double, seq long, done boolean")
    left = {(r["point_id"], r["pass"]) for r in survey.resumed(points, log_).collect()}
    assert left == {(3, "normal"), (3, "occluded")}
    assert {(r["point_id"], r["pass"]) for r in survey.resumed(points, log_, skip_occluded=True).collect()} == {(3, "normal")}
    notes = spark.createDataFrame([("occluded",), ("occluded; by the door",), ("not occluded",), (None,)], "n string")
    assert [r[0] for r in notes.select(survey.note_pass(F.col("n"))).collect()] == ["occluded", "occluded", "normal", "normal"]
