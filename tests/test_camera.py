"""Camera folds against row-by-row loops, on long tracks and poor rows."""

import random
import time
from collections import deque

import numpy as np
import pyarrow as pa
import pytest

from timeloom.operators import camera as M


def row_by_row(ax, ay, face, x, y, persistence=4):
    out, n = [], 0
    for a, b, f in zip(ax, ay, face):
        if bool(M.breaches(np.array([a]), np.array([b]), np.array([f]), x, y)[0]):
            n += 1
        else:
            n = max(0, n - 1)
        moved = n >= persistence
        if moved:
            (x,), (y,) = M.framed(np.array([a]), np.array([b]), np.array([f]))
            n = 0
        out.append((float(x), float(y), moved))
    return out


@pytest.mark.parametrize("step", [5, 60, 400])
def test_reframes_equal_a_loop(step):
    rng = np.random.default_rng(step)
    n = 3000
    ax, ay, face = 900 + np.cumsum(rng.normal(0, step, n)) % 900, rng.uniform(200, 700, n), rng.uniform(100, 400, n)
    got = list(zip(*(v.tolist() for v in M.reframed(ax, ay, face, 700.0, 90.0))))
    assert got == row_by_row(ax, ay, face, 700.0, 90.0) and any(m for *_, m in got)


def test_a_million_rows_of_one_track():
    rng = np.random.default_rng(2)
    n = 1_000_000
    ax, ay, face = 900 + 300 * np.sin(np.arange(n) / 5000) + rng.normal(0, 30, n), np.full(n, 400.0), np.full(n, 200.0)
    began = time.time()
    xs, _, moved = M.reframed(ax, ay, face, 700.0, 90.0)
    assert time.time() - began < 60 and 10 < moved.sum() < n // 100 and np.isfinite(xs).all()


def test_camera_without_scenes_or_subjects(spark):
    samples = spark.createDataFrame([(1, 1, 0, None, None, None), (1, 1, 500, 900.0, 400.0, 200.0), (1, 1, 1000, None, None, None), (1, 2, 0, None, None, None)], "video_id long, track_id long, t_ms long, ax double, ay double, face double")
    scenes = spark.createDataFrame([], "video_id long, scene_idx long, start_ms long, end_ms long")
    got = {(r.track_id, r.t_ms): (r.camera_x, r.camera_y, r.state) for r in M.camera_path(samples, scenes).collect()}
    assert got == {(1, 0): (647, 103, "lock"), (1, 500): (647, 103, "lock"), (1, 1000): (647, 103, "lock"), (2, 0): (707, 90, "lock")}
    assert M.camera_path(samples.limit(0), scenes).collect() == []


def test_chains_equal_the_whole_track(spark):
    """Transitions folded over the whole track give what chains of them give."""
    rng = random.Random(3)
    frames, events = [], []
    for track in (1, 2):
        t = 0
        for _ in range(400):
            t += rng.choice([100, 200, 500])
            frames.append((1, track, t, float(rng.randint(0, 900)), float(rng.randint(0, 400)), rng.uniform(1, 2.5)))
    for _ in range(60):
        events.append((1, rng.randint(-500, 130_000), rng.choice([0, 300, 1500, 4000])))
    f = spark.createDataFrame(frames, "video_id long, track_id long, t_ms long, x double, y double, zoom double")
    e = spark.createDataFrame(events + [(2, 5, 100)], "video_id long, t long, duration_ms long")
    got = {(r.track_id, r.t_ms): (r.x, r.y, r.zoom, r.smoothed) for r in M.smooth_transitions(f, e).collect()}
    assert len(got) == len(frames)
    ordered = sorted((t, d) for _, t, d in events if d)
    for track in (1, 2):
        own = [r for r in frames if r[1] == track]
        t, v = np.array([r[2] for r in own], float), np.array([r[3:] for r in own])
        want, touched = M.eased(t, v, ordered, 0, len(own), (t[0], t[-1]))
        assert [got[track, int(x)] for x in t] == [(*map(float, w), bool(s)) for w, s in zip(want, touched)] and touched.any() and not touched.all()


def test_transition_meets_its_neighbours():
    t = np.arange(0, 10_000, 100.0)
    v = np.stack([np.where(t < 5000, 100.0, 600.0), np.zeros(100), np.ones(100)], axis=1)
    out, touched = M.eased(t, v, [(5000.0, 2000.0)], 0, 100, (t[0], t[-1]))
    assert touched.sum() == 21 and (np.diff(out[touched, 0]) >= 0).all() and out[39, 0] == 100 and out[61, 0] == 600


def test_anchors(spark):
    sample = "video_id long, t_ms long, x long, y long, w long, h long, confidence double"
    face = spark.createDataFrame([(1, 2000, 10, 20, 100, 200, 0.9)], sample)
    body = spark.createDataFrame([(1, 2600, 0, 0, 100, 200, 0.6)], sample)
    frames = spark.createDataFrame([(1, t) for t in range(0, 6001, 500)], "video_id long, t_ms long")
    got = {r.t_ms: (r.anchor_x, r.anchor_y, r.confidence, r.source) for r in M.merged_anchors(face, body, frames, ["video_id"]).collect()}
    assert got[0] == (60.0, 70.0, 0.72, "backfill") and got[1500] == (60.0, 70.0, 0.9, "face") and got[2500] == (60.0, 70.0, 0.9, "face")
    assert got[3000] == (50.0, 84.0, 0.6, "body") and got[3500] == (50.0, 84.0, 0.552, "carried") and got[4500] == (50.0, 84.0, round(0.6 * 0.92**3, 4), "carried")
    assert got[5000] == (None, None, 0.0, "lost")
    lost = {r.source for r in M.merged_anchors(face.limit(0), body.limit(0), frames, ["video_id"]).collect()}
    assert lost == {"lost"}


def test_subject_is_given_up_after_its_first_miss(spark):
    rows = [(1, 0, 1, 50), (1, 0, 2, 40), (1, 1000, None, 0), (1, 2500, 2, 40), (1, 3000, 2, 40), (1, 3100, 2, 40), (1, 3100, 3, 40), (2, 0, None, 0), (2, 500, 7, 1)]
    got = M.subject_switches(spark.createDataFrame(rows, "scene long, t_ms long, subject long, size long"), ["scene"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, None, 1, "initial"), (1, 3100, 1, 2, "disappeared"), (2, 500, None, 7, "initial")]


def test_music_does_not_repeat_within_the_queue(spark):
    clips = spark.createDataFrame([(j, c, "a" if c % 3 else "none") for j in (1, 2) for c in range(200)], "video_id long, clip long, category string")
    pools = {"a": [1, 2, 3, 4, 5, 6], "b": [7, 8]}
    rows = sorted(map(tuple, M.music_choices(clips, pools).collect()))
    for job in (1, 2):
        recent = deque(maxlen=4)
        for _, clip, track in (r for r in rows if r[0] == job):
            size = 6 if clip % 3 else 8
            assert track not in list(recent)[-(size // 2) :] and track in (range(1, 7) if clip % 3 else range(1, 9))
            recent.append(track)
    assert {t for _, _, t in rows} == set(range(1, 9))


def test_folds_share_batches(spark, capsys):
    """F16, F19: many small groups come to a task in shared batches; groups that end inside a batch or reach over several stay whole."""
    rows = spark.range(200).selectExpr("if(id < 40, 0, id div 3) as k", "id % 40 as at", "id as v").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        def fold(t):
            v = t.column("v").to_pylist()
            return pa.table({"k": [t.column("k")[0].as_py()], "n": [len(v)], "total": [sum(v)], "sorted": [t.column("at").to_pylist() == sorted(t.column("at").to_pylist())]})

        d = M.folded(rows, ["k"], ["at"], fold, "k long, n long, total long, sorted boolean")
        got = sorted(tuple(r) for r in d.collect())
        d.explain()
    finally:
        spark.conf.set(name, before)
    groups = {}
    for i in range(200):
        groups.setdefault(0 if i < 40 else i // 3, []).append(i)
    assert got == sorted((k, len(v), sum(v), True) for k, v in groups.items())
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
