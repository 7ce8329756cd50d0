"""Frame streams: finished frames, late events, and changes between consecutive frames."""

import datetime as dt

import numpy as np

from rasterloom.operators import flow
from rasterloom.sources import pixels
from rasterloom.streaming import frames, tracks
from rasterloom.types import Criteria, Shape


def event(i, hours, kind="click"):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours), 1, kind, 1.0, "{}")


def test_changes_between_frames(spark, tmp_path):
    rows = [event(0, 0.1), event(1, 0.2), event(2, 1.5), event(3, 2.1), event(4, 2.2), event(5, 2.3), event(6, 90.0)]
    path = str(tmp_path / "events")
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, frames.EVENTS).coalesce(1).write.mode("append" if k else "overwrite").parquet(path)
    changes = frames.run_to_table(frames.frame_changes(frames.event_stream(spark, path, 10)), str(tmp_path / "out"))
    got = sorted((r["frame"].hour, r["n"], r["change"]) for r in changes.collect())
    assert got == [(0, 2, None), (1, 1, -1), (2, 3, 2)]


def test_batch_frames(spark):
    df = spark.createDataFrame([event(0, 0.5), event(1, 0.6), event(2, 25.0)], frames.EVENTS)
    assert {(r["slot"], r["v"]) for r in frames.frames(df).collect()} == {(0, 2.0), (1, 1.0)}


def test_no_window_stays_open(spark, tmp_path):
    path = str(tmp_path / "events")
    for k, hours in enumerate(((0.1, 0.2, 3.0), (3.5, 7.0))):
        spark.createDataFrame([event(10 * k + i, h) for i, h in enumerate(hours)], frames.EVENTS).coalesce(1).write.mode("append").parquet(path)
    out = frames.run_to_end(spark, path, lambda e: frames.frame_totals(e), str(tmp_path / "out"))
    assert sorted((r["frame"].hour, r["event_type"], r["n"]) for r in out.collect()) == [(0, "click", 2), (3, "click", 2), (7, "click", 1)]


def test_streamed_tracks_are_those_of_batches(spark, tmp_path):
    shape, law, spots = Shape(24, 30), ((7, 7), 1, Criteria(6, 0.01)), [(4, 10.0, 9.0), (7, 18.0, 13.0), (9, 25.0, 20.0)]
    yy, xx = np.mgrid[0:24, 0:30]
    shot = lambda s, n: np.round(100 + 50 * np.sin((xx - 0.8 * n) / 3 + s) + 40 * np.cos((yy + 0.5 * n) / 4 - s), 3)
    rows = [(s, n, shot(s, n).ravel().tolist()) for s in (1, 2) for n in range(5)] + [(3, 0, shot(3, 0).ravel().tolist())]
    first = [r for r in rows if r[1] < 3][::-1] + [(1, None, rows[0][2]), (2, 1, None), (2, 2, [1.0]), (None, 1, rows[0][2])]
    later = [r for r in rows if r[1] >= 3] + [rows[1], (2, 2, rows[0][2])]  # two that come too late
    path, schema = str(tmp_path / "shots"), "stream long, frame long, data array<double>"
    out = None
    for part in (first, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        shots = spark.readStream.schema(schema).parquet(path)
        out = frames.run_to_table(tracks.follow(shots, shape, spots, *law), str(tmp_path / "out"))
    got = {(r["stream"], r["frame"], r["id"]): (r["x"], r["y"], r["status"], r["error"]) for r in out.collect()}
    assert len(got) == 2 * 4 * 3 == out.count()
    images = [pixels.from_arrays(spark.createDataFrame([r for r in rows if r[1] == n and r[0] < 3], schema), "stream", "data", 30) for n in range(5)]
    points = spark.createDataFrame([(s, *p) for s in (1, 2) for p in spots], "img long, id long, x double, y double")
    for n in range(1, 5):
        points = spark.createDataFrame(flow.calc_optical_flow_pyramid_lk(images[n - 1], images[n], shape, points, *law).collect(), "img long, id long, x double, y double, status int, error double")
        for r in points.collect():
            assert np.allclose(got[r["img"], n, r["id"]][:2], (r["x"], r["y"])) and got[r["img"], n, r["id"]][2] == r["status"]
    assert sum(v[2] for v in got.values()) >= 20

