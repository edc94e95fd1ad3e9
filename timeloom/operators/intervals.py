"""Joins on a shared time axis: overlap, containment, point in interval, nearest; and what is snapped with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from timeloom.plans.catalog import query
from timeloom.plans.scratch import materialise

#: Width of the bins that long intervals are dealt to.
BIN_MS = 60_000


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(_dealt(start, end, width))


def _dealt(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def interval_join(left: DataFrame, right: DataFrame, kind: str = "overlap", how: str = "inner", on: str = "video_id", width: int = BIN_MS) -> DataFrame:
    """Pairs of rows of one video by time: the left's ``start_ms, end_ms`` against the right's ``r_start, r_end``.

    kind ``overlap`` is half-open (touching ends don't meet), ``closed`` includes touching, ``contained`` takes right rows
    wholly inside the left, ``contains`` the reverse. Both sides are dealt to time bins and joined on (video, bin), so
    that a long video is many small groups; a pair counts only in the bin where the later start lies. ``how``: inner
    or left. Right columns must not clash with the left's, but for ``on``.
    """
    a, b, c, d = F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")
    rule = {"overlap": (d > a) & (c < b), "closed": (d >= a) & (c <= b), "contained": (c >= a) & (d <= b), "contains": (c <= a) & (d >= b)}[kind]
    r = right.withColumn("_bin", _bins(c, d, width))
    meet = rule & (F.col("_bin") == F.floor(F.greatest(a, c) / width))
    if how == "inner":
        return left.withColumn("_bin", _bins(a, b, width)).join(r, [on, "_bin"]).where(meet).drop("_bin")
    # rows are numbered before they are dealt, so that equal ones stay apart and those with nulls stay at all
    l = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bin", F.explode_outer(_dealt(a, b, width)))
    theirs = [x for x in right.columns if x != on]
    w = Window.partitionBy("_row")
    j = l.join(r, [on, "_bin"], "left").withColumn("_met", F.coalesce(meet, F.lit(False)))
    j = j.withColumns({"_any": F.max("_met").over(w), "_nth": F.row_number().over(w.orderBy(F.desc("_met")))}).where("_met or (not _any and _nth = 1)")
    return j.select(*left.columns, *[F.when(F.col("_met"), F.col(x)).alias(x) for x in theirs])


def as_right(df: DataFrame, **names: str) -> DataFrame:
    """``df`` as a right side: start and end renamed, and further columns by ``names`` (new=old)."""
    return df.select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), *[F.col(o).alias(n) for n, o in names.items()])


def nearest(points: DataFrame, times: DataFrame, at: str, r_at: str, carry: list[str], on: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``points`` with the ``carry`` columns (and ``r_at``) of the row of ``times`` nearest in time; ties to the earlier.

    Both are united, sorted once by time, and the last row before and the first after are carried over each point.
    """
    row = F.struct(F.col(r_at).alias("t"), *carry)
    u = points.select(*points.columns, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(times.select(row).schema[0].dataType).alias("_row"))
    v = times.select(*on, F.col(r_at).alias("_t"), F.lit(0).alias("_side"), row.alias("_row"))
    both = u.unionByName(v, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("_t", "_side", F.col("_row.t"), *[F.col(f"_row.{c}") for c in carry])
    # the same order backwards: a frame that grows is summed up row by row, one that shrinks is read anew for each
    back = Window.partitionBy(*on).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_row.t"), *[F.desc(f"_row.{c}") for c in carry])
    before = F.last("_row", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # of rows at the same later time the first counts, as in a scan with a strict comparison
    after = F.last("_row", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"_b": before, "_a": after}).where("_side = 1")
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_t") - F.col("_b.t") <= F.col("_a.t") - F.col("_t"), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_p", pick).select(*points.columns, F.col("_p.t").alias(r_at), *[F.col(f"_p.{c}").alias(c) for c in carry])


@query("join_speaker_max_overlap", """with t as (select video_id, start_ms, end_ms, speaker from fx_turns), s as (select video_id, seg_idx, start_ms, end_ms from fx_segments),
m as (select s.video_id, s.seg_idx, t.speaker, row_number() over (partition by s.video_id, s.seg_idx order by least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) desc, t.start_ms, t.end_ms) as n
  from s join t on s.video_id = t.video_id and t.end_ms > s.start_ms and t.start_ms < s.end_ms)
select s.video_id, s.seg_idx, m.speaker from s left join m on s.video_id = m.video_id and s.seg_idx = m.seg_idx and m.n = 1""")
def join_speaker_max_overlap(fx_segments, fx_turns):
    """Each segment's speaker: the turn of largest overlap, the earliest of equals; null without overlap."""
    s = fx_segments.select("video_id", "seg_idx", "start_ms", "end_ms")
    j = interval_join(s, as_right(fx_turns, speaker="speaker"))
    over = F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start")
    best = j.groupBy("video_id", "seg_idx").agg(F.max_by("speaker", F.struct(over, -F.col("r_start"), -F.col("r_end"))).alias("speaker"))
    return s.select("video_id", "seg_idx").join(best, ["video_id", "seg_idx"], "left")


@query("join_words_in_clip", "select c.video_id, c.clip, count(*) as n, min(w.idx) as first_idx, max(w.idx) as last_idx from fx_clips c join fx_words w on c.video_id = w.video_id and w.end_ms > c.start_ms and w.start_ms < c.end_ms group by all")
def join_words_in_clip(fx_clips, fx_words):
    """Words that overlap a clip, half-open."""
    j = interval_join(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), as_right(fx_words, idx="idx"))
    return j.groupBy("video_id", "clip").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("join_words_contained", "select c.video_id, c.clip, count(*) as n, sum(w.idx)::bigint as idx_sum from fx_clips c join fx_words w on c.video_id = w.video_id and w.start_ms >= c.start_ms + 100 and w.end_ms <= c.end_ms - 100 group by all")
def join_words_contained(fx_clips, fx_words):
    """Words wholly inside a window."""
    c = fx_clips.select("video_id", "clip", (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 100).alias("end_ms"))
    j = interval_join(c, as_right(fx_words, idx="idx"), "contained")
    return j.groupBy("video_id", "clip").agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"))


def text_between(windows: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered text of the words overlapping each window."""
    j = interval_join(windows.select("video_id", *keys, "start_ms", "end_ms"), as_right(words, idx="idx", word="word"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])
    return j.groupBy("video_id", *keys).agg(F.array_join(texts, " ").alias("text"))


@query("agg_text_between", "select c.video_id, c.clip, string_agg(w.word, ' ' order by w.idx) as text from fx_clips c join fx_words w on c.video_id = w.video_id and w.end_ms > c.start_ms and w.start_ms < c.end_ms group by all")
def agg_text_between(fx_clips, fx_words):
    return text_between(fx_clips, fx_words, ["clip"])


def snap_speech(clips: DataFrame, speech: DataFrame, max_ms: int) -> DataFrame:
    """Clips at the hull of the speech they overlap, at most 250 ms outside, cut to ``max_ms``; without overlap at the
    nearest speech (by the smaller of the distances of starts and ends); unchanged where a video has none."""
    keys = clips.columns
    # written, as both are read several times
    clips, speech = materialise(clips, "clips"), materialise(speech.select("video_id", "start_ms", "end_ms"), "speech")
    j = interval_join(clips, as_right(speech)).groupBy(*keys).agg(F.min("r_start").alias("a"), F.max("r_end").alias("b"))
    s = F.greatest("a", F.col("start_ms") - 250)
    e = F.least("b", F.col("end_ms") + 250)
    hit = j.select(*keys, s.alias("s"), F.least(e, s + max_ms).alias("e"))
    missed = clips.join(hit.select(*keys), keys, "left_anti")
    # the nearest by start and the nearest by end, of which the nearer counts: no clip meets all speech of its video
    times = as_right(speech)
    near = nearest(missed, times.select("video_id", F.col("r_start").alias("at_start"), "r_end"), "start_ms", "at_start", ["r_end"]).withColumnRenamed("r_end", "at_start_end")
    near = nearest(near, times.select("video_id", F.col("r_end").alias("at_end"), "r_start"), "end_ms", "at_end", ["r_start"]).withColumnRenamed("r_start", "at_end_start")
    one = F.struct(F.abs(F.col("at_start") - F.col("start_ms")).alias("gap"), F.col("at_start").alias("r_start"), F.col("at_start_end").alias("r_end"))
    two = F.struct(F.abs(F.col("at_end") - F.col("end_ms")).alias("gap"), F.col("at_end_start").alias("r_start"), F.col("at_end").alias("r_end"))
    near = near.withColumn("n", F.when(F.col("at_start").isNotNull(), F.least(one, two)))
    near = near.select(*keys, F.coalesce("n.r_start", "start_ms").alias("s"), F.coalesce(F.least("n.r_end", F.col("n.r_start") + max_ms), "end_ms").alias("e"))
    return hit.unionByName(near)


@query("join_snap_speech", """with c as (select video_id, clip, start_ms + case when clip % 3 = 0 then 200000000 else 100 end as start_ms, end_ms + case when clip % 3 = 0 then 200000000 else 0 end as end_ms from fx_clips),
h as (select c.video_id, c.clip, c.start_ms, c.end_ms, min(s.start_ms) as a, max(s.end_ms) as b from c join fx_speech s on c.video_id = s.video_id and s.end_ms > c.start_ms and s.start_ms < c.end_ms group by all),
n as (select c.*, s.start_ms as ns, s.end_ms as ne, row_number() over (partition by c.video_id, c.clip order by least(abs(s.start_ms - c.start_ms), abs(s.end_ms - c.end_ms)), s.start_ms) as k from c join fx_speech s using (video_id) where not exists (select 1 from h where h.video_id = c.video_id and h.clip = c.clip))
select video_id, clip, greatest(a, start_ms - 250)::bigint as snap_start, least(least(b, end_ms + 250), greatest(a, start_ms - 250) + 20000)::bigint as snap_end from h
union all select video_id, clip, ns::bigint, least(ne, ns + 20000)::bigint from n where k = 1""")
def join_snap_speech(fx_clips, fx_speech):
    far = F.when(F.col("clip") % 3 == 0, 200_000_000)
    c = fx_clips.select("video_id", "clip", (F.col("start_ms") + F.coalesce(far, F.lit(100))).alias("start_ms"), (F.col("end_ms") + F.coalesce(far, F.lit(0))).alias("end_ms"))
    return snap_speech(c, fx_speech, 20_000).select("video_id", "clip", F.col("s").alias("snap_start"), F.col("e").alias("snap_end"))


def snap_scene(clips: DataFrame, scenes: DataFrame, max_ms: int) -> DataFrame:
    """Clips whose ends move to the hull of their scenes where within 1,250 ms, cut to ``max_ms``; kept if that inverts them."""
    keys = clips.columns
    h = interval_join(clips, as_right(scenes), how="left").groupBy(*keys).agg(F.min("r_start").alias("a"), F.max("r_end").alias("b"))
    s = F.when(F.abs(F.col("start_ms") - F.col("a")) <= 1250, F.col("a")).otherwise(F.col("start_ms"))
    e = F.when(F.abs(F.col("end_ms") - F.col("b")) <= 1250, F.col("b")).otherwise(F.col("end_ms"))
    e = F.least(e, s + max_ms)
    bad = e <= s
    return h.select(*keys, F.when(bad, F.col("start_ms")).otherwise(s).alias("s"), F.when(bad, F.col("end_ms")).otherwise(e).alias("e"))


@query("join_snap_scene", """with h as (select c.video_id, c.clip, c.start_ms, c.end_ms, min(s.start_ms) as a, max(s.end_ms) as b from fx_clips c left join fx_scenes s on c.video_id = s.video_id and s.end_ms > c.start_ms and s.start_ms < c.end_ms group by all),
t as (select *, case when abs(start_ms - a) <= 1250 then a else start_ms end as s, case when abs(end_ms - b) <= 1250 then b else end_ms end as e0 from h), u as (select *, least(e0, s + 15000) as e from t)
select video_id, clip, (case when e <= s then start_ms else s end)::bigint as snap_start, (case when e <= s then end_ms else e end)::bigint as snap_end from u""")
def join_snap_scene(fx_clips, fx_scenes):
    c = fx_clips.select("video_id", "clip", "start_ms", "end_ms")
    return snap_scene(c, fx_scenes, 15_000).select("video_id", "clip", F.col("s").alias("snap_start"), F.col("e").alias("snap_end"))


@query("join_scene_clip", """select c.video_id, c.clip, coalesce(greatest(s.start_ms, c.start_ms), c.start_ms)::bigint as from_ms, coalesce(least(s.end_ms, c.end_ms), c.end_ms)::bigint as to_ms
from fx_clips c left join fx_scenes s on c.video_id = s.video_id and s.end_ms > c.start_ms and s.start_ms < c.end_ms and least(s.end_ms, c.end_ms) - greatest(s.start_ms, c.start_ms) > 50""")
def join_scene_clip(fx_clips, fx_scenes):
    """Scenes cut to the clip, longer than 50 ms; the whole clip where there is none."""
    c = materialise(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), "clips")  # read twice
    cut = interval_join(c, as_right(fx_scenes)).select("video_id", "clip", F.greatest("start_ms", "r_start").alias("a"), F.least("end_ms", "r_end").alias("b")).where("b - a > 50")
    return c.join(cut, ["video_id", "clip"], "left").select("video_id", "clip", F.coalesce("a", "start_ms").alias("from_ms"), F.coalesce("b", "end_ms").alias("to_ms"))


@query("join_scene_midpoint", """select s.video_id, s.scene_idx, coalesce((select min_by(c.clip, c.start_ms) from fx_clips c where c.video_id = s.video_id and (s.start_ms + s.end_ms) / 2 >= c.start_ms and (s.start_ms + s.end_ms) / 2 < c.end_ms), 0)::bigint as layout from fx_scenes s""")
def join_scene_midpoint(fx_scenes, fx_clips):
    """The first interval holding each scene's midpoint, else 0."""
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    s = fx_scenes.select("video_id", "scene_idx", mid.alias("mid"), F.floor(mid).alias("start_ms"), (F.floor(mid) + 1).alias("end_ms"))
    hit = interval_join(s, as_right(fx_clips, clip="clip")).where("mid >= r_start and mid < r_end").groupBy("video_id", "scene_idx").agg(F.min_by("clip", "r_start").alias("layout"))
    return s.select("video_id", "scene_idx").join(hit, ["video_id", "scene_idx"], "left").select("video_id", "scene_idx", F.coalesce("layout", F.lit(0)).cast("long").alias("layout"))


@query("join_point_in_scene", "select w.video_id, w.idx, case when w.start_ms < s.end_ms then s.scene_idx end as scene_idx from fx_words w asof left join fx_scenes s on w.video_id = s.video_id and w.start_ms >= s.start_ms")
def join_point_in_scene(fx_words, fx_scenes):
    """The scene of each point: the last that started, as-of, if it hasn't ended."""
    p = fx_words.select("video_id", "idx", "start_ms")
    u = p.select("video_id", F.col("start_ms").alias("t"), F.lit(1).alias("side"), "idx", F.lit(None).cast("struct<scene_idx:bigint,e:bigint>").alias("s")).unionByName(
        fx_scenes.select("video_id", F.col("start_ms").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("idx"), F.struct(F.col("scene_idx").cast("long").alias("scene_idx"), F.col("end_ms").cast("long").alias("e")).alias("s"))
    )
    last = F.last("s", True).over(Window.partitionBy("video_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    return u.withColumn("s", last).where("side = 1").select("video_id", "idx", F.when(F.col("t") < F.col("s.e"), F.col("s.scene_idx")).alias("scene_idx"))


@query("join_track_scene", """with sc as (select * from (values (0, 0, 20000), (1, 20000, 45000)) t(scene, a, b)) select s.video_id, sc.scene::int as scene, s.track_id, count(*) as n, min(t_ms) as first_ms, max(t_ms) as last_ms from fx_samples s join sc on t_ms >= a and t_ms <= b group by all""")
def join_track_scene(fx_samples):
    """Tracks with samples in an interval (closed ends), and how many."""
    scenes = F.explode(F.array(*[F.struct(F.lit(k).alias("scene"), F.lit(a).alias("start_ms"), F.lit(b).alias("end_ms")) for k, a, b in ((0, 0, 20_000), (1, 20_000, 45_000))]))
    sc = fx_samples.select("video_id").distinct().select("video_id", scenes.alias("s")).select("video_id", "s.*")
    r = fx_samples.select("video_id", F.col("t_ms").alias("r_start"), F.col("t_ms").alias("r_end"), "track_id")
    return interval_join(sc, r, "closed").groupBy("video_id", "scene", "track_id").agg(F.count("*").alias("n"), F.min("r_start").alias("first_ms"), F.max("r_start").alias("last_ms"))


@query("prj_scene_scoped_track", "select video_id, track_id, t_ms, (floor(t_ms / 10000) + 1)::bigint * 10000 + track_id as scoped from fx_samples")
def prj_scene_scoped_track(fx_samples):
    return fx_samples.select("video_id", "track_id", "t_ms", ((F.floor(F.col("t_ms") / 10000) + 1) * 10000 + F.col("track_id")).alias("scoped"))


@query("join_nearest_word", """select c.video_id, c.clip, (select arg_min(w.idx, (abs(w.start_ms - (c.start_ms + 777)), w.start_ms)) from fx_words w where w.video_id = c.video_id)::int as idx from fx_clips c""")
def join_nearest_word(fx_clips, fx_words):
    """The word whose start is nearest to a time; the first of equals."""
    p = fx_clips.select("video_id", "clip", (F.col("start_ms") + 777).alias("at_ms"))
    return nearest(p, fx_words.select("video_id", "start_ms", "idx"), "at_ms", "start_ms", ["idx"]).select("video_id", "clip", "idx")


@query("join_nearest_tolerance", """with g as (select distinct video_id, track_id, (t_ms / 700)::bigint * 700 as at_ms from fx_samples), s as (select video_id, track_id, t_ms, min(conf_pct) as conf from fx_samples group by all)
select g.video_id, g.track_id, g.at_ms, arg_min(t_ms, (abs(t_ms - at_ms), t_ms))::bigint as near_ms from g left join s on s.video_id = g.video_id and s.track_id = g.track_id and abs(t_ms - at_ms) <= 200 group by all""")
def join_nearest_tolerance(fx_samples):
    """The sample nearest to each grid time if within the tolerance, else null."""
    g = fx_samples.select("video_id", "track_id", (F.round(F.col("t_ms") / 700).cast("long") * 700).alias("at_ms")).distinct()
    times = fx_samples.groupBy("video_id", "track_id", F.col("t_ms").cast("long").alias("near_ms")).agg(F.min("conf_pct").alias("conf"))
    near = nearest(g, times, "at_ms", "near_ms", ["conf"], ["video_id", "track_id"])
    return near.select("video_id", "track_id", "at_ms", F.when(F.abs(F.col("near_ms") - F.col("at_ms")) <= 200, F.col("near_ms")).alias("near_ms"))


@query("join_face_to_track", """with f as (select video_id, event_id, t_ms + 100 as t, x + w / 2.0 as cx, y + h / 2.0 as cy from fx_samples where event_id % 3 = 0), p as (select video_id, event_id as pid, t_ms, x, y, w, h from fx_samples where event_id % 3 <> 0)
select f.video_id, f.event_id, arg_min(p.pid, (abs(p.t_ms - f.t), p.pid)) as person from f join p on f.video_id = p.video_id and abs(p.t_ms - f.t) <= 260 and cx between x - 0.1 * w and x + w + 0.1 * w and cy between y - 0.1 * h and y + h + 0.1 * h group by all""")
def join_face_to_track(fx_samples):
    """Each face's person: the nearest sample within 260 ms whose box, padded by a tenth, holds the face's centre."""
    f = fx_samples.where("event_id % 3 = 0").select("video_id", "event_id", (F.col("t_ms") + 100).alias("t"), (F.col("x") + F.col("w") / 2.0).alias("cx"), (F.col("y") + F.col("h") / 2.0).alias("cy"))
    f = f.withColumns({"start_ms": F.col("t") - 260, "end_ms": F.col("t") + 260})
    p = fx_samples.where("event_id % 3 <> 0").select("video_id", F.col("event_id").alias("pid"), F.col("t_ms").alias("r_start"), F.col("t_ms").alias("r_end"), "x", "y", "w", "h")
    pad = lambda at, size: (F.col(at) - F.lit(0.1) * F.col(size), F.col(at) + F.col(size) + F.lit(0.1) * F.col(size))
    j = interval_join(f, p, "closed").where(F.col("cx").between(*pad("x", "w")) & F.col("cy").between(*pad("y", "h")))
    return j.groupBy("video_id", "event_id").agg(F.min_by("pid", F.struct(F.abs(F.col("r_start") - F.col("t")), "pid")).alias("person"))


@query("join_active_identity", """with sw as (select video_id, t_ms as from_ms, track_id as subject, lead(t_ms) over (partition by video_id order by t_ms, track_id) as to_ms from (select video_id, t_ms, min(track_id) as track_id from fx_samples where event_id % 50 = 0 group by all))
select s.video_id, sw.from_ms, sw.subject, count(*) as n from sw join fx_samples s on s.video_id = sw.video_id and s.track_id = sw.subject and s.t_ms >= from_ms and s.t_ms < coalesce(to_ms, 999999999) group by all""")
def join_active_identity(fx_samples):
    """Detections of the subject active in each switch interval."""
    sw = fx_samples.where("event_id % 50 = 0").groupBy("video_id", "t_ms").agg(F.min("track_id").alias("subject"))
    w = Window.partitionBy("video_id").orderBy("t_ms")
    last = F.max("t_ms").over(Window.partitionBy("video_id"))
    sw = sw.select("video_id", F.col("t_ms").alias("from_ms"), "subject", F.lead("t_ms").over(w).alias("to_ms"))
    d = fx_samples.select("video_id", F.col("track_id").alias("subject"), "t_ms")
    return d.join(sw, ["video_id", "subject"]).where((F.col("t_ms") >= F.col("from_ms")) & (F.col("t_ms") < F.coalesce("to_ms", F.lit(999_999_999)))).groupBy("video_id", "from_ms", "subject").agg(F.count("*").alias("n"))


@query("join_first_in_interval", """select c.video_id, c.clip, min_by(w.word, w.start_ms) as word from fx_clips c join fx_words w on c.video_id = w.video_id and w.start_ms >= c.start_ms and w.start_ms < c.end_ms and w.prob_pct >= 90 group by all""")
def join_first_in_interval(fx_clips, fx_words):
    """The first valid sample inside each interval."""
    r = as_right(fx_words.where("prob_pct >= 90"), word="word").withColumn("r_end", F.col("r_start"))
    return interval_join(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), r, "closed").where("r_start < end_ms").groupBy("video_id", "clip").agg(F.min_by("word", "r_start").alias("word"))


@query("prj_clip_relative", "select c.video_id, c.clip, w.idx, greatest(w.start_ms - c.start_ms, 0)::bigint as from_ms, (least(w.end_ms, c.end_ms) - c.start_ms)::bigint as to_ms from (select *, unnest(range((start_ms // 60000)::bigint, (end_ms // 60000 + 1)::bigint)) as bin from fx_clips) c join (select *, unnest(range((start_ms // 60000)::bigint, (end_ms // 60000 + 1)::bigint)) as bin from fx_words) w on c.video_id = w.video_id and c.bin = w.bin and w.end_ms > c.start_ms and w.start_ms < c.end_ms and c.bin = greatest(c.start_ms, w.start_ms) // 60000")
def prj_clip_relative(fx_clips, fx_words):
    """Word times shifted to the clip's origin."""
    j = interval_join(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), as_right(fx_words, idx="idx"))
    return j.select("video_id", "clip", "idx", F.greatest(F.col("r_start") - F.col("start_ms"), F.lit(0)).alias("from_ms"), (F.least("r_end", "end_ms") - F.col("start_ms")).alias("to_ms"))


@query("join_trace_compare", "select a.video_id, a.track_id, a.t_ms, b.x - a.x as dx, b.y - a.y as dy from fx_samples a join fx_samples b on a.video_id = b.video_id and a.track_id = b.track_id and b.t_ms = a.t_ms + 1000")
def join_trace_compare(fx_samples):
    """Offset between two traces at the same time."""
    a = fx_samples.select("video_id", "track_id", "t_ms", "x", "y")
    b = fx_samples.select("video_id", "track_id", (F.col("t_ms") - 1000).alias("t_ms"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, ["video_id", "track_id", "t_ms"]).select("video_id", "track_id", "t_ms", (F.col("bx") - F.col("x")).alias("dx"), (F.col("by") - F.col("y")).alias("dy"))
