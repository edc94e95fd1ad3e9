"""Camera motion: anchors from two sample streams, reframing with hysteresis, subject switches, smoothed transitions, music by clip.

What depends on earlier results row by row is folded in numpy over one group's sorted rows: a group is a segment of a track, a
scene, or a chain of transitions that touch each other, never more of a track than the rule itself needs.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from timeloom.operators.intervals import interval_join, nearest
from timeloom.operators.windows import by_track, islands, win_transition_events
from timeloom.plans.catalog import query

TRACK = ["video_id", "track_id"]
#: Tolerance and longest gap of anchors (ms), confidence kept per carried sample and by filled heads, eye lines in face and body boxes.
TOLERANCE_MS, GAP_MS, DECAY, HEAD, FACE_EYES, BODY_EYES = 500, 1500, 0.92, 0.8, 0.25, 0.42
#: Eye line, headroom, chin and edge margins as shares of the crop, shares of headroom, eyes and edge in the score, the least score, breaches in a row.
EYES, HEADROOM, CHIN, EDGE, SHARES, LEAST, PERSISTENCE = 0.33, 0.08, 0.08, 0.10, (0.40, 0.30, 0.30), 0.40, 4
SOURCE, CROP = (1920.0, 1080.0), (506.0, 900.0)
#: A missing subject is given up after so long; frames to each side of a velocity; bounds of the zoom.
MISSING_MS, REACH, ZOOMS = 2000, 4, (1.0, 2.5)


def folded(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each group's rows, sorted, through ``f``. Spark sorts and marks each group's first row; a task reads its groups one after the other in
    shared batches, as a batch for each of many small groups costs far more than its fold. What is held is a batch and the group that it ends in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def group() -> pa.Table:
            return f(pa.concat_tables(held).combine_chunks() if len(held) > 1 else held[0])

        for b in batches:
            t = pa.Table.from_batches([b])
            first, t = np.flatnonzero(t.column("_nth").to_numpy() == 1).tolist(), t.drop_columns("_nth")
            done = []
            if not first:
                held.append(t)
                continue
            if first[0]:
                held.append(t.slice(0, first[0]))
            for i, j in zip(first, [*first[1:], t.num_rows]):
                if held:
                    done.append(group())
                held = [t.slice(i, j - i)]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from group().to_batches()

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).mapInArrow(run, schema)


def merged_anchors(face: DataFrame, body: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """An anchor for every frame (``keys, t_ms``): of the nearest face sample within TOLERANCE_MS, else of the nearest body
    sample, else the last one carried on for GAP_MS while its confidence decays, else lost; frames before the first anchor take it
    with less confidence. Samples: ``keys, t_ms, x, y, w, h, confidence``; ties go to the earlier sample."""
    c = F.col
    carry = ["x", "y", "w", "h", "confidence"]
    out = frames
    for name, samples in (("face", face), ("body", body)):
        found = nearest(out, samples.withColumnRenamed("t_ms", "_at"), "t_ms", "_at", carry, tuple(keys))
        ok = F.abs(c("_at") - c("t_ms")) <= TOLERANCE_MS
        eyes = FACE_EYES if name == "face" else BODY_EYES
        anchor = F.when(ok, F.struct((c("x") + c("w") / 2.0).alias("x"), (c("y") + c("h") * F.lit(eyes)).alias("y"), c("confidence"), F.lit(name).alias("source")))
        out = found.select(*out.columns, anchor.alias(name))
    order = Window.partitionBy(*keys).orderBy("t_ms")
    so_far, ahead = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc("t_ms")).rowsBetween(Window.unboundedPreceding, 0)
    d = out.withColumns({"a": F.coalesce("face", "body"), "n": F.row_number().over(order)})
    d = d.withColumns({"last": F.last(F.when(c("a").isNotNull(), F.struct("a", "n", "t_ms")), True).over(so_far), "next": F.last("a", True).over(ahead)})
    carried = c("t_ms") - c("last.t_ms") <= GAP_MS
    four = lambda v: F.rint(v * 10000) / 10000
    as_of = lambda of, confidence, source: F.struct(of["x"].alias("x"), of["y"].alias("y"), confidence.alias("confidence"), F.lit(source).alias("source"))
    anchor = (
        F.when(c("a").isNotNull(), c("a")).when(c("last").isNull() & c("next").isNotNull(), as_of(c("next"), four(c("next.confidence") * HEAD), "backfill"))
        .when(carried, as_of(c("last.a"), four(c("last.a.confidence") * F.pow(F.lit(DECAY), (c("n") - c("last.n")).cast("double"))), "carried"))
    )
    d = d.withColumn("anchor", anchor)
    return d.select(*keys, "t_ms", c("anchor.x").alias("anchor_x"), c("anchor.y").alias("anchor_y"), F.coalesce("anchor.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("anchor.source", F.lit("lost")).alias("source"))


@query("win_gap_fill", """with f as (select video_id, track_id, unnest(range(0, max(t_ms)::bigint + 2001, 400)) as t_ms from fx_samples group by video_id, track_id),
d as (select f.video_id, f.track_id, f.t_ms,
  (select min({'d': abs(s.t_ms - f.t_ms), 't': s.t_ms, 'x': s.x + s.w / 2.0, 'y': s.y + s.h * 0.25, 'c': s.conf_pct / 100.0}) from fx_samples s where s.video_id = f.video_id and s.track_id = f.track_id and s.conf_pct >= 70 and abs(s.t_ms - f.t_ms) <= 500) as face,
  (select min({'d': abs(s.t_ms - f.t_ms), 't': s.t_ms, 'x': s.x + s.w / 2.0, 'y': s.y + s.h * 0.42, 'c': s.conf_pct / 100.0}) from fx_samples s where s.video_id = f.video_id and s.track_id = f.track_id and s.conf_pct between 60 and 69 and abs(s.t_ms - f.t_ms) <= 500) as body from f),
a as (select *, coalesce(face, body) as a, case when face is not null then 'face' when body is not null then 'body' end as src, row_number() over w as n from d window w as (partition by video_id, track_id order by t_ms)),
b as (select *, last_value(case when a is not null then {'a': a, 'n': n, 't': t_ms} end ignore nulls) over (partition by video_id, track_id order by t_ms) as l, first_value(a ignore nulls) over (partition by video_id, track_id order by t_ms rows between current row and unbounded following) as nx from a)
select video_id, track_id, t_ms, case when a is not null then a.x when l is null then nx.x when t_ms - l.t <= 1500 then l.a.x end as anchor_x, case when a is not null then a.y when l is null then nx.y when t_ms - l.t <= 1500 then l.a.y end as anchor_y,
  coalesce(case when a is not null then a.c when l is null then round_even(nx.c * 0.8 * 10000, 0) / 10000 when t_ms - l.t <= 1500 then round_even(l.a.c * pow(0.92, (n - l.n)::double) * 10000, 0) / 10000 end, 0.0) as confidence,
  case when a is not null then src when l is null and nx is not null then 'backfill' when t_ms - l.t <= 1500 then 'carried' else 'lost' end as source from b""")
def win_gap_fill(fx_samples):
    s = fx_samples.withColumn("confidence", F.col("conf_pct") / 100.0)
    cut = lambda rule: s.where(rule).select(*TRACK, "t_ms", "x", "y", "w", "h", "confidence")
    frames = s.groupBy(*TRACK).agg(F.max("t_ms").alias("e")).select(*TRACK, F.explode(F.sequence(F.lit(0).cast("long"), F.col("e") + 2000, F.lit(400).cast("long"))).alias("t_ms"))
    return merged_anchors(cut("conf_pct >= 70"), cut("conf_pct between 60 and 69"), frames, TRACK)


def framed(ax, ay, face):
    """Where the crop goes for an anchor: eyes at their line, room above the head and below the chin, inside the picture."""
    (sw, sh), (cw, ch) = SOURCE, CROP
    x, y = ax - cw / 2.0, ay - ch * EYES
    y = np.minimum(y, ay - face * 0.50 - ch * HEADROOM)
    y = np.maximum(y, ay + face * 0.70 + ch * CHIN - ch)
    return np.clip(x, 0.0, sw - cw), np.clip(y, 0.0, sh - ch)


def breaches(ax, ay, face, x, y):
    """Whether a subject stands badly in the crop at ``x, y``: beyond its inner part, or with a poor score of headroom, eyes and edge."""
    cw, ch = CROP
    head = 1.0 - np.clip(np.abs(ay - face * 0.50 - (y + ch * HEADROOM)) / (0.15 * ch), 0.0, 1.0)
    eyes = 1.0 - np.clip(np.abs(ay - (y + ch * EYES)) / (0.20 * ch), 0.0, 1.0)
    edge = ((x + cw * EDGE <= ax) & (ax <= x + cw - cw * EDGE)).astype(float)
    return (ax < x + cw * 0.10) | (ax > x + cw * 0.90) | (SHARES[0] * head + SHARES[1] * eyes + SHARES[2] * edge < LEAST)


def reframed(ax: np.ndarray, ay: np.ndarray, face: np.ndarray, x: float, y: float, persistence: int = PERSISTENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The camera over a segment's rows, starting at ``x, y``: a counter rises with each breach and falls, down to 0, otherwise;
    at ``persistence`` the camera is framed anew on that row. Between reframes the camera stands still, so a stretch of rows is judged at once
    and the counter is a running sum above its running minimum; stretches grow while nothing happens."""
    n, tx, ty = len(ax), *framed(ax, ay, face)
    xs, ys, moved = np.empty(n), np.empty(n), np.zeros(n, bool)
    at, count, size = 0, 0, 64
    while at < n:
        end = min(n, at + size)
        steps = np.where(breaches(ax[at:end], ay[at:end], face[at:end], x, y), 1, -1)
        walk = count + np.cumsum(steps)
        counter = walk - np.minimum(0, np.minimum.accumulate(walk))
        hit = np.flatnonzero(counter >= persistence)
        stop = at + int(hit[0]) if len(hit) else end
        xs[at:stop], ys[at:stop] = x, y
        if len(hit):
            x, y = float(tx[stop]), float(ty[stop])
            xs[stop], ys[stop], moved[stop] = x, y, True
            at, count, size = stop + 1, 0, 64
        else:
            at, count, size = end, int(counter[-1]), min(2 * size, 1 << 16)
    return xs, ys, moved


def camera_path(samples: DataFrame, scenes: DataFrame) -> DataFrame:
    """``camera_x, camera_y, state`` for each sample of a track (``t_ms, ax, ay, face``; null where nobody is seen).

    Within a scene the camera starts at the scene's median framing, and in each scene anew; samples without a subject
    hold it. A track is cut at scene changes, and the pieces are folded apart. A video without scenes is one; samples after the last scene count as
    of the first.
    """
    c = F.col
    samples = samples.withColumn("t_ms", c("t_ms").cast("long"))
    seen = samples.where("ax is not null")
    whole = samples.groupBy("video_id").agg(F.min("t_ms").alias("s"), F.max("t_ms").alias("e")).join(scenes.select("video_id").distinct(), "video_id", "left_anti")
    bounds = scenes.select("video_id", c("scene_idx").cast("long").alias("seg"), c("start_ms").cast("long").alias("s"), c("end_ms").cast("long").alias("e")).unionByName(whole.withColumn("seg", F.lit(0).cast("long")).select("video_id", "seg", "s", "e"))
    inside = interval_join(bounds.withColumnsRenamed({"s": "start_ms", "e": "end_ms"}), seen.select("video_id", c("t_ms").alias("r_start"), c("t_ms").alias("r_end"), "track_id", "ax", "ay", "face"), "closed")
    middle = inside.groupBy(*TRACK, "seg").agg(F.median("ax").alias("mx"), F.median("ay").alias("my"), F.min_by("face", "r_start").alias("mf"))
    # the segment: the last that began before the sample, if it hasn't ended, else the first
    first = bounds.select("video_id", c("s").alias("t"), F.lit(1).alias("side"), F.struct("seg", "e").alias("b"))
    both = seen.select("*", c("t_ms").alias("t"), F.lit(0).alias("side")).unionByName(first, allowMissingColumns=True)
    last = F.last("b", True).over(Window.partitionBy("video_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("b", last).where("side = 0").withColumn("seg", F.when(c("t_ms") <= c("b.e"), c("b.seg")).otherwise(0).cast("long"))
    placed = placed.select(*TRACK, "t_ms", "ax", "ay", "face", "seg").join(middle, [*TRACK, "seg"], "left")
    runs = islands(placed, F.coalesce(c("seg") != F.lag("seg").over(by_track()), F.lit(True)), TRACK, ["t_ms"], "run")

    def fold(t: pa.Table) -> pa.Table:
        ax, ay, face = (t.column(k).to_numpy().astype(float) for k in ("ax", "ay", "face"))
        m = [t.column(k)[0].as_py() for k in ("mx", "my", "mf")]
        x, y = ((SOURCE[0] - CROP[0]) / 2.0, (SOURCE[1] - CROP[1]) / 2.0) if m[0] is None else map(float, framed(*m))
        xs, ys, moved = reframed(ax, ay, face, x, y)
        return pa.table([t.column("video_id"), t.column("track_id"), t.column("t_ms"), pa.array(np.rint(xs).astype(np.int64)), pa.array(np.rint(ys).astype(np.int64)), pa.array(moved)], names=[*TRACK, "t_ms", "camera_x", "camera_y", "moved"])

    path = folded(runs, [*TRACK, "run"], ["t_ms"], fold, "video_id long, track_id long, t_ms long, camera_x long, camera_y long, moved boolean")
    start = middle.where("seg = 0")
    # rows without a subject hold the camera; before the first subject it stands at the first segment's framing
    held = samples.select(*TRACK, "t_ms", c("ax").isNull().alias("empty")).join(path, [*TRACK, "t_ms"], "left").join(start.select(*TRACK, "mx", "my", "mf"), TRACK, "left")
    so_far = by_track().rowsBetween(Window.unboundedPreceding, 0)
    (sw, sh), (cw, ch) = SOURCE, CROP
    clamp = lambda v, high: F.greatest(F.lit(0.0), F.least(v, F.lit(high)))
    y = F.greatest(F.least(c("my") - F.lit(ch * EYES), c("mf") * -0.5 + c("my") - F.lit(ch * HEADROOM)), c("my") + c("mf") * 0.70 + F.lit(ch * CHIN) - F.lit(ch))
    known = lambda v, other: F.when(c("mx").isNotNull(), v).otherwise(F.lit(other))
    begin = {"camera_x": known(clamp(c("mx") - F.lit(cw / 2.0), sw - cw), (sw - cw) / 2.0), "camera_y": known(clamp(y, sh - ch), (sh - ch) / 2.0)}
    return held.select(
        *TRACK, "t_ms", *[F.coalesce(F.last(k, True).over(so_far), F.rint(v).cast("long")).alias(k) for k, v in begin.items()],
        F.when(c("moved"), "reframe").when(c("empty") & (F.last("moved", True).over(so_far)), "reframe").otherwise("lock").alias("state"),
    )


def _camera_sql() -> str:
    fx = "greatest(0.0, least(MX - 253.0, 1414.0))"
    fy = "greatest(0.0, least(greatest(least(MY - 900.0 * 0.33, MY - MF * 0.5 - 900.0 * 0.08), MY + MF * 0.7 + 900.0 * 0.08 - 900.0), 180.0))"
    at = lambda s, x, y, f: s.replace("MX", x).replace("MY", y).replace("MF", f)
    head = "(1.0 - greatest(0.0, least(abs(o.ay - o.face * 0.5 - (g.y + 900.0 * 0.08)) / (0.15 * 900.0), 1.0)))"
    eyes = "(1.0 - greatest(0.0, least(abs(o.ay - (g.y + 900.0 * 0.33)) / (0.20 * 900.0), 1.0)))"
    edge = "(case when g.x + 506.0 * 0.1 <= o.ax and o.ax <= g.x + 506.0 - 506.0 * 0.1 then 1.0 else 0.0 end)"
    bad = f"(o.ax < g.x + 506.0 * 0.1 or o.ax > g.x + 506.0 * 0.9 or 0.4 * {head} + 0.3 * {eyes} + 0.3 * {edge} < 0.4)"
    return f"""with recursive s as (select video_id, track_id, t_ms, case when conf_pct >= 40 then x + w / 2.0 end as ax, case when conf_pct >= 40 then y + h * 0.25 end as ay, case when conf_pct >= 40 then h::double end as face from fx_samples),
b as (select video_id, scene_idx::bigint as seg, start_ms as s, end_ms as e from fx_scenes union all select video_id, 0, min(t_ms), max(t_ms) from s where video_id not in (select video_id from fx_scenes) group by video_id),
m as (select s.video_id, s.track_id, b.seg, median(ax) as mx, median(ay) as my, arg_min(face, t_ms) as mf from s join b on b.video_id = s.video_id and s.t_ms between b.s and b.e where ax is not null group by all),
p as (select s.*, coalesce((select max(b.seg) from b where b.video_id = s.video_id and b.s < s.t_ms and s.t_ms <= b.e and b.s = (select max(c.s) from b c where c.video_id = s.video_id and c.s < s.t_ms)), 0) as seg from s where ax is not null),
o as materialized (select p.*, case when m.mx is null then 707.0 else {at(fx, 'm.mx', 'm.my', 'm.mf')} end as sx, case when m.mx is null then 90.0 else {at(fy, 'm.mx', 'm.my', 'm.mf')} end as sy, {at(fx, 'ax', 'ay', 'face')} as tx, {at(fy, 'ax', 'ay', 'face')} as ty,
  row_number() over w as n, coalesce(p.seg <> lag(p.seg) over w, true) as anew from p left join m using (video_id, track_id, seg) window w as (partition by video_id, track_id order by t_ms)),
g as (select video_id, track_id, 0::bigint as n, 0.0 as x, 0.0 as y, 0 as k, false as mv from o where n = 1
  union all select g.video_id, g.track_id, o.n, case when z.k >= 4 then o.tx else g.x end, case when z.k >= 4 then o.ty else g.y end, case when z.k >= 4 then 0 else z.k end, z.k >= 4
  from (select video_id, track_id, n, x, y, k, mv from g) g0, lateral (select g0.*) q, o, lateral (select g0.video_id, g0.track_id, case when o.anew then o.sx else g0.x end as x, case when o.anew then o.sy else g0.y end as y, case when o.anew then 0 else g0.k end as k) g, lateral (select case when {bad} then g.k + 1 else greatest(0, g.k - 1) end as k) z
  where o.video_id = g0.video_id and o.track_id = g0.track_id and o.n = g0.n + 1),
r as (select s.video_id, s.track_id, s.t_ms, s.ax is null as empty, round_even(g.x, 0)::bigint as x, round_even(g.y, 0)::bigint as y, g.mv, round_even(case when m.mx is null then 707.0 else {at(fx, 'm.mx', 'm.my', 'm.mf')} end, 0)::bigint as bx, round_even(case when m.mx is null then 90.0 else {at(fy, 'm.mx', 'm.my', 'm.mf')} end, 0)::bigint as by_
  from s left join o using (video_id, track_id, t_ms) left join g on g.video_id = o.video_id and g.track_id = o.track_id and g.n = o.n left join m on m.video_id = s.video_id and m.track_id = s.track_id and m.seg = 0)
select video_id, track_id, t_ms, coalesce(last_value(x ignore nulls) over w, bx) as camera_x, coalesce(last_value(y ignore nulls) over w, by_) as camera_y, case when coalesce(last_value(mv ignore nulls) over w, false) then 'reframe' else 'lock' end as state from r window w as (partition by video_id, track_id order by t_ms)"""


@query("win_breach_hysteresis", _camera_sql())
def win_breach_hysteresis(fx_samples, fx_scenes):
    seen = lambda v: F.when(F.col("conf_pct") >= 40, v)
    s = fx_samples.select(*TRACK, "t_ms", seen(F.col("x") + F.col("w") / 2.0).alias("ax"), seen(F.col("y") + F.col("h") * F.lit(FACE_EYES)).alias("ay"), seen(F.col("h").cast("double")).alias("face"))
    return camera_path(s, fx_scenes)


def subject_switches(seen: DataFrame, keys: list[str]) -> DataFrame:
    """``t_ms, before, subject, reason``: whom the camera follows in each group of ``keys`` (``t_ms``; ``subject`` null where a frame
    has nobody; ``size``). First the largest of the first frame with anybody; when the one followed has been missing for over MISSING_MS, counted from its first
    missing frame, the largest of the frame takes over. Ties go to the smaller number."""
    frames = seen.withColumn("t_ms", F.col("t_ms").cast("long")).groupBy(*keys, "t_ms").agg(F.max_by("subject", F.when(F.col("subject").isNotNull(), F.struct("size", (-F.col("subject")).alias("s")))).alias("largest"), F.collect_set("subject").alias("seen"))
    types = {f.name: f.dataType.simpleString() for f in seen.schema}

    def fold(t: pa.Table) -> pa.Table:
        active = since = None
        out = []
        for at, largest, here in zip(*(t.column(c).to_pylist() for c in ("t_ms", "largest", "seen"))):
            if active is None:
                if largest is not None:
                    active = largest
                    out.append((at, None, active, "initial"))
            elif active in here:
                since = None
            else:
                since = at if since is None else since
                if at - since > MISSING_MS and largest is not None:
                    out.append((at, active, largest, "disappeared"))
                    active, since = largest, None
        columns = list(zip(*out)) or [[], [], [], []]
        same = [pa.array([t.column(k)[0].as_py()] * len(out), t.schema.field(k).type) for k in keys]
        return pa.table([*same, *(pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=[*keys, "t_ms", "before", "subject", "reason"])

    return folded(frames, keys, ["t_ms"], fold, ", ".join(f"{k} {types[k]}" for k in keys) + ", t_ms long, before long, subject long, reason string")


@query("win_subject_switch", """with recursive s as (select s.video_id, s.t_ms, case when conf_pct >= 45 then track_id end as subject, conf_pct * w * h as size, coalesce(c.scene_idx, -1)::bigint as scene_idx from fx_samples s asof left join fx_scenes c on s.video_id = c.video_id and s.t_ms >= c.start_ms),
f as (select video_id, scene_idx, t_ms, (max({'a': size, 'b': -subject}) filter (where subject is not null)).b * -1 as largest, list(subject) filter (where subject is not null) as seen from s group by all),
o as materialized (select *, row_number() over (partition by video_id, scene_idx order by t_ms) as n from f),
g as (select video_id, scene_idx, 0::bigint as n, null::bigint as active, null::bigint as since, null::bigint as before, null::varchar as reason from o where n = 1
  union all select g.video_id, g.scene_idx, o.n, case when y.go then o.largest else g.active end, case when y.go or y.here then null else y.since end, case when y.go then g.active end, case when y.go then case when g.active is null then 'initial' else 'disappeared' end end
  from g, o, lateral (select coalesce(list_contains(o.seen, g.active), false) as here, case when g.active is not null then coalesce(g.since, o.t_ms) end as since) x, lateral (select x.here, x.since, o.largest is not null and (g.active is null or not x.here and o.t_ms - x.since > 2000) as go) y
  where o.video_id = g.video_id and o.scene_idx = g.scene_idx and o.n = g.n + 1)
select g.video_id, g.scene_idx, o.t_ms, g.before, g.active as subject, g.reason from g join o using (video_id, scene_idx, n) where g.reason is not null""")
def win_subject_switch(fx_samples, fx_scenes):
    s = fx_samples.select("video_id", F.col("t_ms").alias("t"), F.lit(1).alias("side"), F.when(F.col("conf_pct") >= 45, F.col("track_id")).alias("subject"), (F.col("conf_pct") * F.col("w") * F.col("h")).alias("size"))
    both = s.unionByName(fx_scenes.select("video_id", F.col("start_ms").alias("t"), F.lit(0).alias("side"), F.col("scene_idx").cast("long").alias("scene_idx")), allowMissingColumns=True)
    scene = F.last("scene_idx", True).over(Window.partitionBy("video_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("scene_idx", F.coalesce(scene, F.lit(-1).cast("long"))).where("side = 1").withColumnRenamed("t", "t_ms")
    return subject_switches(placed, ["video_id", "scene_idx"])


def eased(t: np.ndarray, values: np.ndarray, events: list[tuple[float, float]], low: int, total: int, bounds: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """A stretch of a track's frames (the ``low``-th on, of ``total``; axes as columns: x, y, zoom) with its transitions (time, duration) applied in
    order, each to what the ones before left; and which frames changed. Inside a window frames follow the cubic that meets position and velocity of the last frame before and the first
    after; at an end of the track they rest. ``bounds``: times of the track's first and last frame, at which windows are cut."""
    v, touched = values.astype(float).copy(), np.zeros(len(t), bool)

    def speed(i: int) -> np.ndarray:
        a, b = max(0, i - REACH), min(len(t) - 1, i + REACH)
        return (v[b] - v[a]) / (t[b] - t[a]) if t[b] > t[a] else np.zeros(v.shape[1])

    for at, duration in events:
        start, end = max(at - duration / 2.0, bounds[0]), min(at + duration / 2.0, bounds[1])
        i, j = int(np.searchsorted(t, start, "left")), int(np.searchsorted(t, end, "right")) - 1
        if j - i < 1:
            continue
        zero, span = np.zeros(v.shape[1]), max(1.0, end - start)
        p0, m0 = (v[i - 1].copy(), speed(i - 1)) if low + i > 0 else (v[i].copy(), zero)
        p1, m1 = (v[j + 1].copy(), speed(j + 1)) if low + j < total - 1 else (v[j].copy(), zero)
        u = np.clip((t[i : j + 1] - start) / span, 0.0, 1.0)[:, None]
        new = (2 * u**3 - 3 * u**2 + 1) * p0 + (u**3 - 2 * u**2 + u) * (m0 * span) + (-2 * u**3 + 3 * u**2) * p1 + (u**3 - u**2) * (m1 * span)
        new[:, :2] = np.rint(np.maximum(0.0, new[:, :2]))
        new[:, 2] = np.rint(np.clip(new[:, 2], *ZOOMS) * 10000) / 10000
        v[i : j + 1], touched[i : j + 1] = new, True
    return v, touched


def smooth_transitions(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Frames (``video_id, track_id, t_ms, x, y, zoom``) with their video's transitions (``t, duration_ms``) smoothed.

    Transitions whose frames, or frames that they read, meet form a chain; a track is cut into its chains, which are folded apart and
    in parallel, and all other frames pass through untouched. Equal times of events are taken shorter first.
    """
    c = F.col
    f = frames.select(*TRACK, c("t_ms").cast("long").alias("t_ms"), *[c(a).cast("double").alias(a) for a in ("x", "y", "zoom")])
    f = f.withColumn("i", F.row_number().over(by_track()) - 1)
    ends = f.groupBy(*TRACK).agg(F.min("t_ms").alias("first"), F.max("t_ms").alias("last"), F.count("*").alias("total"))
    e = events.select("video_id", c("t").cast("double").alias("t"), c("duration_ms").cast("double").alias("d")).where("d > 0").join(ends, "video_id")
    e = e.withColumns({"start_ms": F.greatest(c("t") - c("d") / 2.0, "first"), "end_ms": F.least(c("t") + c("d") / 2.0, "last")}).where("start_ms <= end_ms")
    e = e.withColumn("on", F.struct(*TRACK))
    hits = interval_join(e.select("on", "t", "d", "start_ms", "end_ms", "total", "first", "last"), f.select(F.struct(*TRACK).alias("on"), c("t_ms").alias("r_start"), c("t_ms").alias("r_end"), "i"), "closed", on="on")
    reach = hits.groupBy("on", "t", "d", "total", "first", "last").agg(F.min("i").alias("a"), F.max("i").alias("b")).where("b > a")
    reach = reach.withColumns({"a": F.greatest(c("a") - REACH - 1, F.lit(0)), "b": c("b") + REACH + 1})
    w = Window.partitionBy("on").orderBy("a", "t", "d")
    apart = c("a") > F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    chained = islands(reach, apart, ["on"], ["a", "t", "d"], "chain")
    chains = chained.groupBy("on", "chain").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("total").alias("total"), F.first("first").alias("first"), F.first("last").alias("last"), F.sort_array(F.collect_list(F.struct("t", "d"))).alias("events"))
    starts = chains.select(c("on.video_id").alias("video_id"), c("on.track_id").alias("track_id"), c("a").alias("i"), F.lit(0).alias("side"), F.struct("chain", "a", "b", "total", "first", "last", "events").alias("k"))
    both = f.withColumn("side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    k = F.last("k", True).over(Window.partitionBy(*TRACK).orderBy("i", "side").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("k", k).where("side = 1").withColumn("k", F.when(c("i") <= c("k.b"), c("k")))
    axes = ["x", "y", "zoom"]

    def fold(t: pa.Table) -> pa.Table:
        chain = t.column("k")[0].as_py()
        v, touched = eased(t.column("t_ms").to_numpy().astype(float), np.stack([t.column(a).to_numpy() for a in axes], axis=1), [(x["t"], x["d"]) for x in chain["events"]], chain["a"], chain["total"], (chain["first"], chain["last"]))
        return pa.table([*(t.column(n) for n in (*TRACK, "t_ms")), *(pa.array(v[:, n]) for n in range(3)), pa.array(touched)], names=[*TRACK, "t_ms", *axes, "smoothed"])

    inside = both.where("k is not null").withColumn("chain", c("k.chain"))
    changed = folded(inside, [*TRACK, "chain"], ["i"], fold, "video_id long, track_id long, t_ms long, x double, y double, zoom double, smoothed boolean")
    return both.where("k is null").select(*TRACK, "t_ms", *axes, F.lit(False).alias("smoothed")).unionByName(changed)


def _transition_sql() -> str:
    """Each axis of a track is one list, which every transition rewrites in turn."""
    speed = lambda i: f"(case when g.ts[least(g.n_f, {i} + 4)] > g.ts[greatest(1, {i} - 4)] then (g.vs[least(g.n_f, {i} + 4)] - g.vs[greatest(1, {i} - 4)]) / (g.ts[least(g.n_f, {i} + 4)] - g.ts[greatest(1, {i} - 4)]) else 0.0 end)"
    return f"""with recursive fr as (select video_id, track_id, t_ms, unnest(['x', 'y', 'zoom']) as axis, unnest([x::double, y::double, 1 + conf_pct / 100.0]) as v from fx_samples),
f as (select video_id, track_id, axis, list(t_ms::double order by t_ms) as ts, list(v order by t_ms) as vs, count(*) as n_f from fr group by all),
l as (select video_id, start_ms as t, (scene_idx * 5 + video_id) % 4 as layout from fx_scenes), bo as (select video_id, t from (select *, lag(layout) over (partition by video_id order by t) as p from l) x where p is not null and p <> layout),
ev as (select video_id, t, 2400 as d from bo union all select video_id, start_ms + 100, 1500 from fx_scenes where scene_idx > 0 and scene_idx % 2 = 0 and not exists (select 1 from bo where bo.video_id = fx_scenes.video_id and abs(bo.t - start_ms - 100) <= 250)),
e as materialized (select video_id, t::double as t, d::double as d, row_number() over (partition by video_id order by t, d) as n from ev),
g as (select video_id, track_id, axis, 0::bigint as n, ts, vs, n_f, list_transform(ts, lambda z: false) as sm from f
  union all select g.video_id, g.track_id, g.axis, e.n, g.ts, case when b.j > b.i then list_transform(range(1, g.n_f + 1), lambda i: case when i between b.i and b.j then (case when g.axis = 'zoom' then round_even(greatest(1.0, least(VAL, 2.5)) * 10000, 0) / 10000 else round_even(greatest(0.0, VAL), 0) end) else g.vs[i] end) else g.vs end, g.n_f,
    case when b.j > b.i then list_transform(range(1, g.n_f + 1), lambda i: i between b.i and b.j or g.sm[i]) else g.sm end
  from g join e on e.video_id = g.video_id and e.n = g.n + 1,
    lateral (select greatest(e.t - e.d / 2.0, g.ts[1]) as s, least(e.t + e.d / 2.0, g.ts[g.n_f]) as z) w, lateral (select w.s, w.z, len(list_filter(g.ts, lambda q: q < w.s)) + 1 as i, len(list_filter(g.ts, lambda q: q <= w.z)) as j) b,
    lateral (select greatest(1.0, b.z - b.s) as span, g.vs[greatest(1, b.i - 1)] as p0, case when b.i > 1 then {speed('(b.i - 1)')} else 0.0 end as m0, g.vs[least(g.n_f, b.j + 1)] as p1, case when b.j < g.n_f then {speed('(b.j + 1)')} else 0.0 end as m1) p),
last as (select * from g where n = coalesce((select max(e.n) from e where e.video_id = g.video_id), 0)),
u as (select video_id, track_id, axis, unnest(ts)::bigint as t_ms, unnest(vs) as v, unnest(sm) as smoothed from last)
select video_id, track_id, t_ms, max(case when axis = 'x' then v end) as x, max(case when axis = 'y' then v end) as y, max(case when axis = 'zoom' then v end) as zoom, bool_or(smoothed) as smoothed from u group by video_id, track_id, t_ms""".replace("VAL", _cubic_sql())


def _cubic_sql() -> str:
    u = "greatest(0.0, least((g.ts[i] - b.s) / p.span, 1.0))"
    return f"((2 * pow({u}, 3.0) - 3 * pow({u}, 2.0) + 1) * p.p0 + (pow({u}, 3.0) - 2 * pow({u}, 2.0) + {u}) * (p.m0 * p.span) + (-2 * pow({u}, 3.0) + 3 * pow({u}, 2.0)) * p.p1 + (pow({u}, 3.0) - pow({u}, 2.0)) * (p.m1 * p.span))"


@query("win_hermite", _transition_sql())
def win_hermite(fx_samples, fx_scenes):
    frames = fx_samples.select(*TRACK, "t_ms", "x", "y", (1 + F.col("conf_pct") / 100.0).alias("zoom"))
    events = win_transition_events(fx_scenes).select("video_id", "t", F.when(F.col("kind") == "cut", 1500).otherwise(2400).alias("duration_ms"))
    return smooth_transitions(frames, events)


def music_choices(clips: DataFrame, tracks: dict[str, list[int]], key: str = "video_id", order: str = "clip", category: str = "category") -> DataFrame:
    """A track for each clip of a job, in order: from its category's pool (all tracks, if that has none) without the last
    ``max(1, n // 2)`` picks of the job, n being the pool's size, by a stable hash of job and clip. If those are all, they count again. The state is a queue of the
    longest such window."""
    every = sorted({t for pool in tracks.values() for t in pool})
    pools = {k: sorted(set(v)) for k, v in tracks.items()}
    longest = max(1, len(every) // 2)
    types = {f.name: f.dataType.simpleString() for f in clips.schema}

    def fold(t: pa.Table) -> pa.Table:
        recent, out = deque(maxlen=longest), []
        for job, clip, kind in zip(*(t.column(c).to_pylist() for c in (key, order, category))):
            pool = pools.get(kind) or every
            if len(pool) > 1:
                last = set(list(recent)[-max(1, len(pool) // 2) :])
                pool = [x for x in pool if x not in last] or pool
            pick = pool[int(hashlib.md5(f"{job}:{clip}".encode()).hexdigest()[:8], 16) % len(pool)]
            recent.append(pick)
            out.append(pick)
        return pa.table([t.column(key), t.column(order), pa.array(out, pa.int64())], names=[key, order, "track"])

    return folded(clips.select(key, order, category), [key], [order], fold, f"{key} {types[key]}, {order} {types[order]}, track long")


@query("gen_music_choice", """with recursive c as (select video_id, clip, case (video_id + clip) % 4 when 0 then [0, 1, 2] when 1 then [2, 3, 4, 5, 6] when 2 then [7] else [0, 1, 2, 3, 4, 5, 6, 7, 8, 9] end as pool, row_number() over (partition by video_id order by clip) as n from fx_clips),
g as (select video_id, 0::bigint as n, 0::bigint as clip, 0::bigint as track, []::bigint[] as recent from c where n = 1
  union all select g.video_id, c.n, c.clip, z.pick, list_append(case when len(g.recent) > 4 then g.recent[-4:] else g.recent end, z.pick) from g join c on c.video_id = g.video_id and c.n = g.n + 1,
  lateral (select case when len(g.recent) > greatest(1, len(c.pool) // 2) then g.recent[-greatest(1, len(c.pool) // 2):] else g.recent end as recent) r,
  lateral (select list_filter(c.pool, lambda x: not list_contains(r.recent, x)) as fresh) f, lateral (select case when len(c.pool) > 1 and len(f.fresh) > 0 then f.fresh else c.pool end as pool) p,
  lateral (select p.pool[(('0x' || left(md5(c.video_id::varchar || ':' || c.clip::varchar), 8))::bigint % len(p.pool))::bigint + 1]::bigint as pick) z)
select video_id, clip, track from g where n > 0""")
def gen_music_choice(fx_clips):
    kind = F.element_at(F.array(*map(F.lit, ["calm", "bright", "single", "none"])), ((F.col("video_id") + F.col("clip")) % 4 + 1).cast("int"))
    return music_choices(fx_clips.withColumn("category", kind), {"calm": [0, 1, 2], "bright": [2, 3, 4, 5, 6], "single": [7], "rest": [8, 9]})
