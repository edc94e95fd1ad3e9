"""Aggregations over tracks, scenes, speakers, clips, projects and runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from timeloom.functions import columns as C
from timeloom.operators.intervals import as_right, interval_join
from timeloom.plans.catalog import query
from timeloom.plans.scratch import materialise


def upper_median(values):
    """The upper middle element of an array."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def weighted_median(df, keys: list[str], value: str, weight: str):
    """Per group the first value, in order, at which the cumulative weight reaches half."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_c": F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)), "_t": F.sum(weight).over(w)})
    return d.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def selected_median(df: DataFrame, keys: list[str], value: str, weight: str, bins: int = 1024, small: int = 50_000) -> DataFrame:
    """``weighted_median`` for groups of any size: no group is sorted in one task.

    Equal values are added up first. While a group's range holds more than ``small`` distinct values, the range is cut into ``bins``
    parts, their weights are summed on all tasks, and the part in which half is reached is the next range; only then the values left
    are sorted. Exact at any size: each pass halves the range at least, since its least and largest value fall in different parts. The
    driver asks once a pass whether a group is still large. Values must be finite, weights not negative; rows where either is null don't count,
    groups without any are left out as those of null keys are, groups of no weight give their smallest value."""
    c, w = F.col, Window.partitionBy(*keys)
    v = materialise(df.where(c(value).isNotNull() & c(weight).isNotNull()).groupBy(*keys, c(value).alias("_v")).agg(F.sum(weight).alias("_w")), "median-values")
    state = materialise(v.groupBy(*keys).agg((F.sum("_w") / 2).alias("_half"), (F.sum("_w") * 0).alias("_below"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")), "median-ranges")
    while not state.where((c("_n") > small) & (c("_lo") < c("_hi"))).isEmpty():
        large = (c("_n") > small) & (c("_lo") < c("_hi"))
        lo, hi = c("_lo").cast("double"), c("_hi").cast("double")
        part = F.least(F.lit(bins - 1), F.floor((c("_v") - lo) / (hi - lo) * bins))
        h = v.join(state.where(large), keys).where("_v between _lo and _hi").groupBy(*keys, "_half", "_below", part.alias("_part"))
        h = h.agg(F.sum("_w").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
        h = h.withColumn("_upto", c("_below") + F.sum("_in").over(w.orderBy("_part"))).where("_upto >= _half").withColumn("_nth", F.row_number().over(w.orderBy("_part"))).where("_nth = 1")
        state = materialise(state.where(~large).unionByName(h.select(*keys, "_half", (c("_upto") - c("_in")).alias("_below"), "_lo", "_hi", "_n")), "median-ranges")
    last = v.join(state, keys).where("_v between _lo and _hi")
    return last.withColumn("_upto", c("_below") + F.sum("_w").over(w.orderBy("_v"))).where("_upto >= _half").groupBy(*keys).agg(F.min("_v").alias("weighted_median"))


@query("agg_frame_best_person", "select video_id, t_ms, arg_max(event_id, (w * h * conf_pct, -event_id)) as best, count(*) as persons, count(*) filter (where w * h / (1920.0 * 1080.0) >= 0.03) as primaries from fx_samples group by all")
def agg_frame_best_person(fx_samples):
    """Best person of a frame by area and confidence, counts, and how many are large."""
    area = F.col("w") * F.col("h")
    return fx_samples.groupBy("video_id", "t_ms").agg(F.max_by("event_id", F.struct(area * F.col("conf_pct"), -F.col("event_id"))).alias("best"), F.count("*").alias("persons"), F.count_if(area / F.lit(1920.0 * 1080.0) >= 0.03).alias("primaries"))


#: Milestones by what a log line says, whatever its case; of several the first in this order. A caller's own list takes its place.
MILESTONES = (
    ("extracting audio|\"stage\":\"audio\"", "Extracting audio"), ("voice activity|\"stage\":\"vad\"", "Detecting speech"), ("transcribing|transcription", "Understanding conversation"), ("diarization", "Identifying speakers"),
    ("highlight", "Finding moments"), ("candidate", "Selecting highlights"), ("scene", "Detecting scenes"), ("tracking|faces", "Tracking faces"), ("camera|anchors|framing", "Framing"), ("rendering clip|\"stage\":\"cut\"", "Rendering clips"),
    ("captions", "Writing captions"), ("metadata", "Generating metadata"), ("export", "Preparing export"), ("complete|finished|done", "Completed"),
)


def log_milestones(lines: DataFrame, milestones=MILESTONES) -> DataFrame:
    """Each job's first line (by ``seq``) of every milestone."""
    text, m = F.lower("line"), F.lit(None).cast("string")
    for pattern, name in reversed(milestones):
        m = F.when(text.rlike(pattern), name).otherwise(m)
    return lines.select("job", "seq", m.alias("milestone")).where("milestone is not null").groupBy("job", "milestone").agg(F.min("seq").alias("first_seq"))


@query("agg_log_milestones", "select job, milestone, min(seq) as first_seq from (select job, seq, case " + " ".join(f"when regexp_matches(lower(line), '{p}') then '{m}'" for p, m in MILESTONES) + " end as milestone from fx_lines) t where milestone is not null group by all")
def agg_log_milestones(fx_lines):
    return log_milestones(fx_lines)


@query("agg_track_summary", "select video_id, track_id, min(t_ms) as start_ms, max(t_ms) as end_ms, count(*) as n, avg(conf_pct) as conf, string_agg(event_id::varchar, ',' order by t_ms, event_id) as frames from fx_samples group by all")
def agg_track_summary(fx_samples):
    frames = F.transform(F.sort_array(F.collect_list(F.struct("t_ms", "event_id"))), lambda x: x["event_id"].cast("string"))
    return fx_samples.groupBy("video_id", "track_id").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count("*").alias("n"), F.avg("conf_pct").alias("conf"), F.array_join(frames, ",").alias("frames"))


@query("agg_identity_summary", "select video_id, track_id as subject, min(event_id) as first_frame, max(event_id) as last_frame, min(t_ms) as from_ms, max(t_ms) as to_ms, count(*) as n, avg(conf_pct) as conf from fx_samples where conf_pct >= 40 group by all")
def agg_identity_summary(fx_samples):
    return fx_samples.where("conf_pct >= 40").groupBy("video_id", F.col("track_id").alias("subject")).agg(F.min("event_id").alias("first_frame"), F.max("event_id").alias("last_frame"), F.min("t_ms").alias("from_ms"), F.max("t_ms").alias("to_ms"), F.count("*").alias("n"), F.avg("conf_pct").alias("conf"))


@query("agg_speaker_roles", "with r as (select video_id, speaker, avg(case when text like '%?%' then 1.0 else 0.0 end) as q from fx_turns group by all) select video_id, speaker, case when count(*) over (partition by video_id) = 1 then 'solo' when q > 0.3 then 'host' else 'guest' end as role from r")
def agg_speaker_roles(fx_turns):
    """Who asks in over 30 % of their turns is the host, others guests; a single speaker is solo."""
    r = fx_turns.groupBy("video_id", "speaker").agg(F.avg(F.when(F.col("text").contains("?"), 1.0).otherwise(0.0)).alias("q"))
    alone = F.count("*").over(Window.partitionBy("video_id")) == 1
    return r.select("video_id", "speaker", F.when(alone, "solo").when(F.col("q") > 0.3, "host").otherwise("guest").alias("role"))


@query("agg_role_distribution", "select video_id, speaker, count(*) as n, count(*) * 1.0 / sum(count(*)) over (partition by video_id) as share from fx_turns group by video_id, speaker")
def agg_role_distribution(fx_turns):
    d = fx_turns.groupBy("video_id", "speaker").agg(F.count("*").alias("n"))
    return d.withColumn("share", F.col("n") * F.lit(1.0) / F.sum("n").over(Window.partitionBy("video_id")))


@query("agg_block_confidence", "select video_id, idx // 40 as block, avg(prob_pct) as conf, avg(prob_pct) < 70 as low from fx_words group by all")
def agg_block_confidence(fx_words):
    return fx_words.groupBy("video_id", F.floor(F.col("idx") / 40).alias("block")).agg(F.avg("prob_pct").alias("conf"), (F.avg("prob_pct") < 70).alias("low"))


@query("agg_region_confidence", "select c.video_id, c.clip, min_by(prob_pct, idx) as start_prob, max_by(prob_pct, idx) as end_prob, avg(prob_pct) as mean_prob, count(*) filter (where prob_pct < 60) as low, min_by(prob_pct, idx) < 60 or max_by(prob_pct, idx) < 60 as low_at_boundary from fx_clips c join fx_words w on c.video_id = w.video_id and w.end_ms > c.start_ms and w.start_ms < c.end_ms group by all")
def agg_region_confidence(fx_clips, fx_words):
    j = interval_join(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), as_right(fx_words, idx="idx", prob_pct="prob_pct"))
    a, b = F.min_by("prob_pct", "idx"), F.max_by("prob_pct", "idx")
    return j.groupBy("video_id", "clip").agg(a.alias("start_prob"), b.alias("end_prob"), F.avg("prob_pct").alias("mean_prob"), F.count_if(F.col("prob_pct") < 60).alias("low"), ((a < 60) | (b < 60)).alias("low_at_boundary"))


SCENE = "floor(t_ms / 10000)"


def _scenes(fx_samples):
    return fx_samples.withColumn("scene", F.floor(F.col("t_ms") / 10000))


_IMPORTANCE = """imp as (select video_id, scene, track_id, n / frames as presence, conf / 100.0 as conf, areas[n // 2 + 1] / (1920.0 * 1080.0) as area, xs[n // 2 + 1] / 1920.0 as cx from (
  select video_id, (t_ms // 10000)::bigint as scene, track_id, count(*) as n, avg(conf_pct) as conf, list_sort(list(w * h)) as areas, list_sort(list(x + w / 2.0)) as xs from fx_samples group by all) a
  join (select video_id, (t_ms // 10000)::bigint as scene, count(distinct t_ms) * 1.0 as frames from fx_samples group by all) b using (video_id, scene)),
ok as (select *, presence >= 0.05 and conf >= 0.4 and area >= 0.025 and cx between 0.1 and 0.9 as important from imp)"""


def scene_importance(samples):
    """Per scene and track: presence, confidence, upper-median area and centre, and whether they reach their floors."""
    s = _scenes(samples)
    t = s.groupBy("video_id", "scene", "track_id").agg(F.count("*").alias("n"), F.avg("conf_pct").alias("c"), F.collect_list(F.col("w") * F.col("h")).alias("areas"), F.collect_list(F.col("x") + F.col("w") / 2.0).alias("xs"))
    f = s.groupBy("video_id", "scene").agg((F.countDistinct("t_ms") * F.lit(1.0)).alias("frames"))
    j = t.join(f, ["video_id", "scene"]).select("video_id", "scene", "track_id", (F.col("n") / F.col("frames")).alias("presence"), (F.col("c") / 100.0).alias("conf"), (upper_median(F.col("areas")) / F.lit(1920.0 * 1080.0)).alias("area"), (upper_median(F.col("xs")) / 1920.0).alias("cx"))
    return j.withColumn("important", (F.col("presence") >= 0.05) & (F.col("conf") >= 0.4) & (F.col("area") >= 0.025) & F.col("cx").between(0.1, 0.9))


@query("agg_scene_importance", f"with {_IMPORTANCE} select * from ok")
def agg_scene_importance(fx_samples):
    return scene_importance(fx_samples)


@query("agg_sampled_frames", "select video_id, count(distinct t_ms) as frames from fx_samples where t_ms >= 5000 and t_ms <= 20000 group by all")
def agg_sampled_frames(fx_samples):
    return fx_samples.where(F.col("t_ms").between(5000, 20000)).groupBy("video_id").agg(F.countDistinct("t_ms").alias("frames"))


@query("agg_content_only", "select video_id, scene, not bool_or(n >= 2) and not bool_or(a <= scene * 10000 and b >= scene * 10000 + 9000) as content_only from (select video_id, (t_ms // 10000)::bigint as scene, track_id, count(*) as n, min(t_ms) as a, max(t_ms) as b from fx_samples where conf_pct >= 90 group by all) t group by all")
def agg_content_only(fx_samples):
    """Scenes without a track that spans them or has two hits."""
    t = _scenes(fx_samples.where("conf_pct >= 90")).groupBy("video_id", "scene", "track_id").agg(F.count("*").alias("n"), F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    spans = (F.col("a") <= F.col("scene") * 10000) & (F.col("b") >= F.col("scene") * 10000 + 9000)
    return t.groupBy("video_id", "scene").agg((~F.bool_or(F.col("n") >= 2) & ~F.bool_or(spans)).alias("content_only"))


@query("agg_scene_composition", f"with {_IMPORTANCE} select video_id, scene, count(*) filter (where important) as subjects, case count(*) filter (where important) when 0 then 'content_only' when 1 then 'single' else 'conversation' end as shot from ok group by all")
def agg_scene_composition(fx_samples):
    n = F.count_if("important")
    return scene_importance(fx_samples).groupBy("video_id", "scene").agg(n.alias("subjects"), F.when(n == 0, "content_only").when(n == 1, "single").otherwise("conversation").alias("shot"))


@query("agg_track_dedupe", """with t as (select video_id, (t_ms // 10000)::bigint as scene, track_id, avg(x + w / 2.0) as cx, row_number() over (partition by video_id, (t_ms // 10000)::bigint order by count(*) desc, track_id) as n from fx_samples where conf_pct >= 80 group by video_id, (t_ms // 10000)::bigint, track_id),
g as (select video_id, scene, 1::bigint as n, [cx] as kept, [track_id] as ids from t where n = 1
 union all select g.video_id, g.scene, t.n, case when len(list_filter(g.kept, lambda k: abs(k - t.cx) < 345.6)) > 0 then g.kept else list_append(g.kept, t.cx) end, case when len(list_filter(g.kept, lambda k: abs(k - t.cx) < 345.6)) > 0 then g.ids else list_append(g.ids, t.track_id) end from g join t on t.video_id = g.video_id and t.scene = g.scene and t.n = g.n + 1)
select video_id, scene, unnest(ids) as track_id from (select video_id, scene, arg_max(ids, n) as ids from g group by all) x""")
def agg_track_dedupe(fx_samples):
    """Per scene, tracks by size; one whose mean centre is within 18 % of the width of a kept one goes."""
    t = _scenes(fx_samples.where("conf_pct >= 80")).groupBy("video_id", "scene", "track_id").agg(F.count("*").alias("n"), F.avg(F.col("x") + F.col("w") / 2.0).alias("cx"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "track_id", "cx")))
    start = F.array().cast("array<struct<track_id:bigint,cx:double>>")
    fold = F.aggregate(rows, start, lambda kept, r: F.when(F.exists(kept, lambda k: F.abs(k["cx"] - r["cx"]) < 345.6), kept).otherwise(F.array_append(kept, F.struct(r["track_id"].alias("track_id"), r["cx"].alias("cx")))))
    return t.groupBy("video_id", "scene").agg(fold.alias("k")).select("video_id", "scene", F.explode("k").alias("k")).select("video_id", "scene", "k.track_id")


@query("agg_identity_count", "select video_id, count(*) as identities from (select video_id, track_id from fx_samples where t_ms between 10000 and 30000 group by all having count(*) >= 5) t group by all")
def agg_identity_count(fx_samples):
    return fx_samples.where(F.col("t_ms").between(10000, 30000)).groupBy("video_id", "track_id").agg(F.count("*").alias("n")).where("n >= 5").groupBy("video_id").agg(F.count("*").alias("identities"))


@query("agg_best_track", "select video_id, arg_max(track_id, (score, -track_id)) as track_id, max(score) as score from (select video_id, track_id, count(*) * (avg(conf_pct) / 100.0) * (1 + least(1.0, avg(w * h) / 80000.0)) as score from fx_samples group by all) t group by all")
def agg_best_track(fx_samples):
    t = fx_samples.groupBy("video_id", "track_id").agg((F.count("*") * (F.avg("conf_pct") / 100.0) * (1 + F.least(F.lit(1.0), F.avg(F.col("w") * F.col("h")) / 80000.0))).alias("score"))
    return t.groupBy("video_id").agg(F.max_by("track_id", F.struct("score", -F.col("track_id"))).alias("track_id"), F.max("score").alias("score"))


@query("agg_subject_selection", """with f as (select video_id, (t_ms // 10000)::bigint as scene, count(distinct t_ms) * 1.0 as frames from fx_samples group by all),
t as (select video_id, (t_ms // 10000)::bigint as scene, track_id, count(*) as n, avg(conf_pct) / 100.0 as conf, avg(w * h) / (1920.0 * 1080.0) as area, avg(case when x >= 57.6 and x + w <= 1862.4 then 1.0 else 0.0 end) as safe from fx_samples group by all),
s as (select t.*, 0.5 * (n / frames) + 0.25 * conf + 0.15 * least(1.0, area * 4) + 0.1 * safe as score, n / frames >= 0.5 and safe >= 0.75 as accepted from t join f using (video_id, scene))
select video_id, scene, track_id, score, accepted from (select *, row_number() over (partition by video_id, scene order by score desc, track_id) as k from s) x where k = 1""")
def agg_subject_selection(fx_samples):
    """Per scene the subject of the best weighted coverage, confidence, area and edge safety; accepted above two floors."""
    s = _scenes(fx_samples)
    f = s.groupBy("video_id", "scene").agg((F.countDistinct("t_ms") * F.lit(1.0)).alias("frames"))
    safe = F.when((F.col("x") >= 57.6) & (F.col("x") + F.col("w") <= 1862.4), 1.0).otherwise(0.0)
    t = s.groupBy("video_id", "scene", "track_id").agg(F.count("*").alias("n"), (F.avg("conf_pct") / 100.0).alias("conf"), (F.avg(F.col("w") * F.col("h")) / F.lit(1920.0 * 1080.0)).alias("area"), F.avg(safe).alias("safe")).join(f, ["video_id", "scene"])
    cover = F.col("n") / F.col("frames")
    t = t.withColumns({"score": 0.5 * cover + 0.25 * F.col("conf") + 0.15 * F.least(F.lit(1.0), F.col("area") * 4) + 0.1 * F.col("safe"), "accepted": (cover >= 0.5) & (F.col("safe") >= 0.75)})
    return t.withColumn("k", F.row_number().over(Window.partitionBy("video_id", "scene").orderBy(F.desc("score"), "track_id"))).where("k = 1").select("video_id", "scene", "track_id", "score", "accepted")


@query("agg_scene_layout", "select video_id, scene, case when avg(case when persons > 1 then 1.0 else 0.0 end) >= 0.35 then 'pad' else 'crop' end as layout from (select video_id, (t_ms // 10000)::bigint as scene, t_ms, count(*) as persons from fx_samples group by all) t group by all")
def agg_scene_layout(fx_samples):
    """Padding where over a third of the frames show several persons, else a crop."""
    p = _scenes(fx_samples).groupBy("video_id", "scene", "t_ms").agg(F.count("*").alias("persons"))
    return p.groupBy("video_id", "scene").agg(F.when(F.avg(F.when(F.col("persons") > 1, 1.0).otherwise(0.0)) >= 0.35, "pad").otherwise("crop").alias("layout"))


@query("agg_weighted_centroid", "select video_id, t_ms, sum((x + w / 2.0) * (conf_pct * w * h)) / sum(conf_pct * w * h) as cx, sum((y + h * 0.2) * (conf_pct * w * h)) / sum(conf_pct * w * h) as cy from (select * from fx_samples order by video_id, t_ms, event_id) t group by all")
def agg_weighted_centroid(fx_samples):
    """Confidence times area as weight of each frame's boxes."""
    k = F.col("conf_pct") * F.col("w") * F.col("h")
    mean = lambda v: F.sum(v * k) / F.sum(k)
    return fx_samples.groupBy("video_id", "t_ms").agg(mean(F.col("x") + F.col("w") / 2.0).alias("cx"), mean(F.col("y") + F.col("h") * 0.2).alias("cy"))


@query("agg_weighted_median", "select video_id, min(x) as weighted_median from (select video_id, x, sum(conf_pct) over (partition by video_id order by x) as c, sum(conf_pct) over (partition by video_id) as t from fx_samples) s where c >= t / 2 group by all")
def agg_weighted_median(fx_samples):
    return selected_median(fx_samples, ["video_id"], "x", "conf_pct")


@query("agg_stable_anchor", "select video_id, edge, min(x) as weighted_median from (select *, sum(conf_pct) over (partition by video_id, edge order by x) as c, sum(conf_pct) over (partition by video_id, edge) as t from (select video_id, x, conf_pct, case when t_ms <= a + 1500 then 'start' when t_ms >= b - 1500 then 'end' end as edge from (select *, min(t_ms) over (partition by video_id) as a, max(t_ms) over (partition by video_id) as b from fx_samples) p) q where edge is not null) s where c >= t / 2 group by all")
def agg_stable_anchor(fx_samples):
    """Weighted median over the first and last 1.5 s."""
    w = Window.partitionBy("video_id")
    edge = F.when(F.col("t_ms") <= F.min("t_ms").over(w) + 1500, "start").when(F.col("t_ms") >= F.max("t_ms").over(w) - 1500, "end")
    return weighted_median(fx_samples.withColumn("edge", edge).where("edge is not null"), ["video_id", "edge"], "x", "conf_pct")


#: Reasons that force the padded fallback; of a clipped subject only where no face was measured.
FATAL_REASONS = ["crop_outside_source_bounds", "no_selected_subject_detections", "selected_subject_missing_for_most_of_clip", "face_missing_for_most_of_clip", "face_materially_clipped", "face_near_horizontal_edge", "forehead_headroom_unsafe", "chin_clearance_unsafe"]
FATAL_WITHOUT_FACE = "selected_subject_materially_clipped"


def _places3(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000.0


def _against_crop(boxes: DataFrame, crops: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Per crop: number of boxes (``x, y, w, h``), least and mean share inside the crop, least margins of the box in it and median share of the crop's area."""
    c = F.col
    d = boxes.select(*keys, *[c(n).cast("double").alias(n) for n in "xywh"]).where("x is not null and y is not null and w is not null and h is not null").join(crops.select(*keys, "cx", "cy", "cw", "ch"), keys)
    inside = F.greatest(F.lit(0.0), F.least(c("x") + c("w"), c("cx") + c("cw")) - F.greatest("x", "cx")) * F.greatest(F.lit(0.0), F.least(c("y") + c("h"), c("cy") + c("ch")) - F.greatest("y", "cy"))
    area, centre = F.greatest(F.lit(1.0), c("w") * c("h")), c("x") + c("w") / 2.0
    side = F.least(centre - c("cx"), c("cx") + c("cw") - centre) / F.greatest("cw", F.lit(1.0))
    top, bottom = (c("y") - c("cy")) / F.greatest("ch", F.lit(1.0)), (c("cy") + c("ch") - (c("y") + c("h"))) / F.greatest("ch", F.lit(1.0))
    figures = {"n": F.count("*"), "least": F.min(inside / area), "mean": F.avg(inside / area), "side": F.min(side), "top": F.min(top), "bottom": F.min(bottom), "body": F.median(area / F.greatest(c("cw") * c("ch"), F.lit(1.0)))}
    return d.groupBy(*keys).agg(*[f.alias(prefix + n) for n, f in figures.items()])


def composition_report(crops: DataFrame, subjects: DataFrame, faces: DataFrame, keys: list[str], interval_ms: int = 500) -> DataFrame:
    """A static crop (``cx, cy, cw, ch`` in a source of ``width, height`` over ``duration_ms``) against the selected subject's boxes
    and its faces (``x, y, w, h``), by ``keys``: status, reasons in order, an index and the figures they rest on.

    Where faces were measured they alone decide on failure (besides the source's bounds); else coverage and clipping of the subject
    do. Any other reason is a warning. Crops without boxes are reported, boxes with nulls are left out, figures are null where
    nothing was measured."""
    c = F.col
    frame = crops.select(*keys, *[c(n).cast("double").alias(n) for n in ("cx", "cy", "cw", "ch")], "width", "height", "duration_ms")
    q = frame.join(_against_crop(subjects, frame, keys, "s_"), keys, "left").join(_against_crop(faces, frame, keys, "f_"), keys, "left")
    q = q.withColumns({"bounds_valid": (c("cw") > 0) & (c("ch") > 0) & (c("cx") >= 0) & (c("cy") >= 0) & (c("cx") + c("cw") <= c("width")) & (c("cy") + c("ch") <= c("height")), "_expected": F.ceil(F.greatest(c("duration_ms"), F.lit(0)) / float(interval_ms)) + 1})
    share = lambda n: F.least(F.lit(1.0), F.coalesce(n, F.lit(0)) / c("_expected"))
    q = q.withColumns({"coverage": share(c("s_n")), "face_coverage": F.when(c("f_n").isNotNull(), share(c("f_n")))})
    measured = c("f_n").isNotNull()
    no = lambda test: F.coalesce(test, F.lit(False))
    face_faults = [(c("face_coverage") < 0.50, "face_missing_for_most_of_clip"), (c("f_least") < 0.98, "face_materially_clipped"), (c("f_side") < 0.15, "face_near_horizontal_edge"), (c("f_top") < 0.06, "forehead_headroom_unsafe"), (c("f_bottom") < 0.10, "chin_clearance_unsafe")]
    rules = [
        (~no(c("bounds_valid")), "crop_outside_source_bounds"), (c("s_n").isNull(), "no_selected_subject_detections"), (c("coverage") < 0.50, "selected_subject_missing_for_most_of_clip"),
        ((c("coverage") >= 0.50) & (c("coverage") < 0.75), "selected_subject_tracking_incomplete"), (c("s_least") < 0.70, "selected_subject_materially_clipped"),
        ((c("s_least") >= 0.70) & (c("s_least") < 0.90), "selected_subject_partially_clipped"), (c("s_side") < 0.15, "selected_subject_near_horizontal_edge"), *face_faults,
    ]
    reasons = F.array_compact(F.array(*[F.when(no(t), F.lit(r)) for t, r in rules]))
    face_failed = F.lit(False)
    for test, _ in face_faults:
        face_failed = face_failed | no(test)
    failed = ~no(c("bounds_valid")) | F.when(measured, face_failed).otherwise((c("coverage") < 0.50) | no(c("s_least") < 0.70))
    parts = [F.when(no(c("bounds_valid")), 1.0).otherwise(0.0), c("coverage"), c("s_mean"), F.when(c("s_side").isNotNull(), F.least(F.lit(1.0), c("s_side") / 0.15))]
    index = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / sum((F.when(p.isNull(), 0).otherwise(1) for p in parts), F.lit(0))
    named = {"coverage": "coverage", "min_containment": "s_least", "avg_containment": "s_mean", "min_side_margin": "s_side", "body_coverage": "s_body", "face_coverage": "face_coverage", "face_min_containment": "f_least", "face_min_side_margin": "f_side", "face_min_top_margin": "f_top", "face_min_bottom_margin": "f_bottom"}
    status = F.when(failed, "fail").when(F.size("reasons") > 0, "warning").otherwise("pass")
    return q.withColumn("reasons", reasons).select(*keys, status.alias("status"), "reasons", "bounds_valid", measured.alias("face_measured"), _places3(index).alias("quality_index"), *[_places3(c(v)).alias(k) for k, v in named.items()])


def fit_guard(report: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a report's reasons force the padded fallback, and which of them do."""
    fatal = lambda r: r.isin(FATAL_REASONS) | (~F.col("face_measured") & (r == FATAL_WITHOUT_FACE))
    return report.select(*keys, F.filter("reasons", fatal).alias("reasons")).select(*keys, (F.size("reasons") > 0).alias("forced"), "reasons")


def _static_crops(fx_samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per track a crop around the mean of its boxes, kept inside on the left only; subjects where detection is fair, faces where it is good."""
    c = F.col
    centre = F.floor(F.sum(2 * c("x") + c("w")) / (2 * F.count("*")))
    crops = fx_samples.groupBy("video_id", "track_id").agg(F.greatest(F.lit(0), centre - 304).alias("cx"), (F.max("t_ms") - F.min("t_ms")).alias("duration_ms"))
    crops = crops.select("*", F.lit(0).alias("cy"), F.lit(608).alias("cw"), F.lit(1080).alias("ch"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    subjects = fx_samples.where((c("conf_pct") >= 30) & (c("track_id") % 7 != 0))
    faces = fx_samples.where((c("conf_pct") >= 45) & (c("track_id") % 3 != 0)).select("video_id", "track_id", (c("x") + c("w") * 0.31).alias("x"), (c("y") + c("h") * 0.07).alias("y"), (c("w") * 0.38).alias("w"), (c("h") * 0.22).alias("h"))
    return crops, subjects, faces


_SHARE_IN = "greatest(0.0, least(x + w, cx + 608.0) - greatest(x, cx)) * greatest(0.0, least(y + h, 1080.0) - greatest(y, 0.0)) / greatest(1.0, w * h)"
_SIDE_IN = "least(x + w / 2.0 - cx, cx + 608.0 - (x + w / 2.0)) / 608.0"
_FACE_FAULTS = {"face_missing_for_most_of_clip": "fcov < 0.50", "face_materially_clipped": "f_least < 0.98", "face_near_horizontal_edge": "f_side < 0.15", "forehead_headroom_unsafe": "f_top < 0.06", "chin_clearance_unsafe": "f_bottom < 0.10"}
_FAULTS = {
    "crop_outside_source_bounds": "not valid", "no_selected_subject_detections": "s_n is null", "selected_subject_missing_for_most_of_clip": "cov < 0.50", "selected_subject_tracking_incomplete": "cov >= 0.50 and cov < 0.75",
    "selected_subject_materially_clipped": "s_least < 0.70", "selected_subject_partially_clipped": "s_least >= 0.70 and s_least < 0.90", "selected_subject_near_horizontal_edge": "s_side < 0.15", **_FACE_FAULTS,
}
_QA = f"""k as (select video_id, track_id, greatest(0, floor(sum(2 * x + w) / (2 * count(*))) - 304)::double as cx, max(t_ms) - min(t_ms) as ms from fx_samples group by all),
s as (select video_id, track_id, count(*) as s_n, min({_SHARE_IN}) as s_least, avg({_SHARE_IN}) as s_mean, min({_SIDE_IN}) as s_side, median(greatest(1.0, w * h) / 656640.0) as s_body from (select video_id, track_id, x::double as x, y::double as y, w::double as w, h::double as h from fx_samples where conf_pct >= 30 and track_id % 7 <> 0) b join k using (video_id, track_id) group by all),
f as (select video_id, track_id, count(*) as f_n, min({_SHARE_IN}) as f_least, min({_SIDE_IN}) as f_side, min(y / 1080.0) as f_top, min((1080.0 - (y + h)) / 1080.0) as f_bottom from (select video_id, track_id, x + w * 0.31 as x, y + h * 0.07 as y, w * 0.38 as w, h * 0.22 as h from fx_samples where conf_pct >= 45 and track_id % 3 <> 0) b join k using (video_id, track_id) group by all),
m as (select *, cx + 608 <= 1920 as valid, least(1.0, coalesce(s_n, 0) / (ceil(greatest(ms, 0) / 500.0) + 1)) as cov, case when f_n is not null then least(1.0, f_n / (ceil(greatest(ms, 0) / 500.0) + 1)) end as fcov from k left join s using (video_id, track_id) left join f using (video_id, track_id)),
qa as (select *, list_filter([{", ".join(f"case when {t} then '{r}' end" for r, t in _FAULTS.items())}], lambda x: x is not null) as reasons,
 not valid or case when f_n is not null then {" or ".join(f"coalesce({t}, false)" for t in _FACE_FAULTS.values())} else cov < 0.50 or coalesce(s_least < 0.70, false) end as failed,
 (case when valid then 1.0 else 0.0 end + cov + coalesce(s_mean, 0.0) + case when s_side is null then 0.0 else least(1.0, s_side / 0.15) end) / (2 + case when s_n is null then 0 else 2 end) as q from m)"""
_R3 = ", ".join(f"floor({v} * 1000 + 0.5) / 1000.0 as {k}" for k, v in {"quality_index": "q", "coverage": "cov", "min_containment": "s_least", "avg_containment": "s_mean", "min_side_margin": "s_side", "body_coverage": "s_body", "face_coverage": "fcov", "face_min_containment": "f_least", "face_min_side_margin": "f_side", "face_min_top_margin": "f_top", "face_min_bottom_margin": "f_bottom"}.items())


@query("agg_composition_qa", f"with {_QA} select video_id, track_id, case when failed then 'fail' when len(reasons) > 0 then 'warning' else 'pass' end as status, array_to_string(reasons, ',') as reasons, valid as bounds_valid, f_n is not null as face_measured, {_R3} from qa")
def agg_composition_qa(fx_samples):
    """The report of a static crop for each track."""
    return composition_report(*_static_crops(fx_samples), ["video_id", "track_id"]).withColumn("reasons", F.array_join("reasons", ","))


@query("agg_fit_guard", f"with {_QA}, x as (select *, list_filter(reasons, lambda r: r in ({', '.join(f"'{r}'" for r in FATAL_REASONS)}) or (f_n is null and r = '{FATAL_WITHOUT_FACE}')) as fatal from qa) select video_id, track_id, len(fatal) > 0 as forced, array_to_string(fatal, ',') as reasons from x")
def agg_fit_guard(fx_samples):
    """Reasons that force the fallback, those among the fatal ones."""
    keys = ["video_id", "track_id"]
    return fit_guard(composition_report(*_static_crops(fx_samples), keys), keys).withColumn("reasons", F.array_join("reasons", ","))


@query("agg_topic_diversity", "select video_id, cand, case when score < 20 then 0.0 else greatest(0.5, 1.0 - (count(*) filter (where score >= 20) over (partition by video_id, topic_id) - 1) * 0.2) end as diversity from fx_candidates")
def agg_topic_diversity(fx_candidates):
    """0 for rejected rows; else less the more retained rows share the topic, at least 0.5."""
    n = F.count(F.when(F.col("score") >= 20, 1)).over(Window.partitionBy("video_id", "topic_id"))
    return fx_candidates.select("video_id", "cand", F.when(F.col("score") < 20, 0.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 1) * F.lit(0.2))).alias("diversity"))


@query("agg_keywords", "with t as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from (select doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') as w from documents) d), k as (select doc_id, word, count(*) as n, min(pos) as first_pos from t where word not in ('the','and','for','that','with','this','are','was','were') group by all) select doc_id, word, n, rank from (select *, row_number() over (partition by doc_id order by n desc, first_pos) as rank from k) r where rank <= 12")
def agg_keywords(documents):
    """The twelve most frequent words but stop words, ties by first occurrence."""
    t = documents.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("pos", "word")).where(~F.col("word").isin("the", "and", "for", "that", "with", "this", "are", "was", "were"))
    k = t.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos"))).where("rank <= 12").select("doc_id", "word", "n", "rank")


NICHES = {"news": ["that", "from", "tion", "only"], "tech": ["ing", "ment", "ness", "able"], "story": ["les", "der", "und", "que"]}


@query("agg_niche", "with k as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as w from documents), h as (select doc_id, len(list_intersect(w, ['that','from','tion','only'])) as a, len(list_intersect(w, ['ing','ment','ness','able'])) as b, len(list_intersect(w, ['les','der','und','que'])) as c from k) select doc_id, case when greatest(a, b, c) = 0 then 'podcast' when a >= b and a >= c then 'news' when b >= c then 'tech' else 'story' end as niche from h")
def agg_niche(documents):
    """The niche whose vocabulary (tags without ``#``) overlaps most; a default without overlap; ties to the earlier."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    n = {k: F.size(F.array_intersect(w, F.array(*map(F.lit, v)))) for k, v in NICHES.items()}
    best = F.greatest(*n.values())
    out = F.when(best == 0, "podcast")
    for k, v in n.items():
        out = out.when(v == best, k)
    return documents.select("doc_id", out.alias("niche"))


@query("agg_coverage", "select video_id, (max(end_ms) - min(start_ms)) / 60000.0 as coverage, (max(end_ms) - min(start_ms)) / 60000.0 >= 0.6 as enough from fx_clips group by all")
def agg_coverage(fx_clips):
    c = (F.max("end_ms") - F.min("start_ms")) / F.lit(60000.0)
    return fx_clips.groupBy("video_id").agg(c.alias("coverage"), (c >= 0.6).alias("enough"))


#: Anchors that a profile needs, mean step of the body and spans of the anchor (pixels) beyond which a talk is dynamic or a presentation.
PROFILE_ANCHORS, DYNAMIC_STEP, DYNAMIC_SPAN, PRESENTED_SPAN = 4, 40.0, 400.0, 250.0


def content_profile(anchors: DataFrame, keys: list[str], order: str, tracks: Column) -> DataFrame:
    """``profile, certainty, span, step`` of each group of anchors (``anchor_x``, ``body_x``, ``body_y``, null where nobody is seen):
    dynamic if bodies or anchors move far, a conversation if there are several ``tracks``, a presentation if the
    anchor wanders, else a podcast, with little certainty where anchors are few."""
    c = F.col
    seen = anchors.withColumn("_tracks", tracks)
    last = F.lag(F.struct("body_x", "body_y")).over(Window.partitionBy(*keys).orderBy(order))
    valid = seen.where("anchor_x is not null")
    steps = valid.where("body_x is not null").withColumn("_last", last).withColumn("step", F.sqrt(F.pow(c("body_x") - c("_last.body_x"), 2.0) + F.pow(c("body_y") - c("_last.body_y"), 2.0)))
    steps = steps.groupBy(*keys).agg(F.avg("step").alias("step"))
    g = seen.groupBy(*keys).agg(F.count("anchor_x").alias("n"), (F.max("anchor_x") - F.min("anchor_x")).alias("span"), F.max("_tracks").alias("tracks")).join(steps, keys, "left")
    far = (F.coalesce("step", F.lit(0.0)) > DYNAMIC_STEP) | (c("span") > DYNAMIC_SPAN)
    few = c("n") < PROFILE_ANCHORS
    pick = lambda *v: F.when(few, F.lit(v[0])).when(far, v[1]).when(c("tracks") > 1, v[2]).when(c("span") > PRESENTED_SPAN, v[3]).otherwise(v[4])
    return g.select(*keys, pick("podcast", "dynamic", "conversation", "presentation", "podcast").alias("profile"), pick(0.60, 0.88, 0.84, 0.82, 0.94).alias("certainty"), F.coalesce("span", F.lit(0.0)).alias("span"), F.coalesce("step", F.lit(0.0)).alias("step"))


@query("agg_content_profile", """with t as (select video_id, count(distinct track_id) as tracks from fx_samples where track_id % 10 < 4 + video_id % 5 and (video_id % 3 > 0 or track_id % 10 = 0) group by all),
a as (select s.video_id, s.track_id, s.t_ms, case when conf_pct >= 40 then (x + w / 2.0) / (1 + s.track_id % 4) end as ax, x / 10.0 / (1 + s.track_id % 7) as bx, y / 10.0 / (1 + s.track_id % 7) as by_ from fx_samples s where s.track_id % 10 < 4 + s.video_id % 5 and (s.video_id % 3 > 0 or s.track_id % 10 = 0)),
d as (select *, sqrt(pow(bx - lag(bx) over w, 2.0) + pow(by_ - lag(by_) over w, 2.0)) as step from a where ax is not null window w as (partition by video_id, track_id order by t_ms)),
g as (select a.video_id, a.track_id, count(ax) as n, max(ax) - min(ax) as span, max(t.tracks) as tracks from a join t using (video_id) group by all), m as (select video_id, track_id, avg(step) as step from d group by all)
select video_id, track_id, case when n < 4 then 'podcast' when coalesce(step, 0) > 40 or span > 400 then 'dynamic' when tracks > 1 then 'conversation' when span > 250 then 'presentation' else 'podcast' end as profile,
  case when n < 4 then 0.60 when coalesce(step, 0) > 40 or span > 400 then 0.88 when tracks > 1 then 0.84 when span > 250 then 0.82 else 0.94 end::double as certainty, coalesce(span, 0.0) as span, coalesce(step, 0.0) as step from g left join m using (video_id, track_id)""")
def agg_content_profile(fx_samples):
    c = F.col
    s = fx_samples.where("track_id % 10 < 4 + video_id % 5 and (video_id % 3 > 0 or track_id % 10 = 0)")
    n = s.groupBy("video_id").agg(F.countDistinct("track_id").alias("n_tracks"))
    a = s.withColumns({"anchor_x": F.when(c("conf_pct") >= 40, (c("x") + c("w") / 2.0) / (1 + c("track_id") % 4)), "body_x": c("x") / 10.0 / (1 + c("track_id") % 7), "body_y": c("y") / 10.0 / (1 + c("track_id") % 7)})
    return content_profile(a.join(n, "video_id"), ["video_id", "track_id"], "t_ms", c("n_tracks"))


@query("agg_segment_median", "select video_id, (t_ms // 10000)::bigint as scene, median(x + w / 2.0) as cx, median(y) as cy from fx_samples group by all")
def agg_segment_median(fx_samples):
    return _scenes(fx_samples).groupBy("video_id", "scene").agg(F.median(F.col("x") + F.col("w") / 2.0).alias("cx"), F.median("y").alias("cy"))


#: What a fault takes off (short segment, other ratio, crop outside, stock hook, no brand tag, poor title), and the grades.
FAULTS = {"short": 10, "ratio": 15, "outside": 25, "stock": 10, "brand": 15, "title": 20}
GRADES = ((93, "A+"), (87, "A"), (80, "B+"))


def quality_grades(videos: DataFrame, segments: DataFrame, crops: DataFrame, hooks: DataFrame, metadata: DataFrame, source: tuple[int, int], brands: list[str], stock: list[str], shortest: int = 1200) -> DataFrame:
    """``layout, crop, hooks, metadata, overall, grade`` of each video: four scores of 0 to 100, a quarter each; 50 where a video has no rows.

    ``segments`` (start_ms, end_ms) lose by each short one, ``crops`` (x, y, w, h) by each that isn't 9:16 or leaves the
    source, ``hooks`` (hook) by the share of repeats and by stock phrases, ``metadata`` (title, tags) by missing brand tags and poor titles.
    """
    c = F.col
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v.cast("double")))
    outside = (c("x") < 0) | (c("y") < 0) | (c("x") + c("w") > source[0] + 1) | (c("y") + c("h") > source[1] + 1)
    ratio = F.abs(F.when(c("h") == 0, 0.0).otherwise(c("w") / c("h")) - F.lit(9.0 / 16.0)) > 0.02
    hook = F.lower(F.trim("hook"))
    said = F.lit(False)
    for phrase in stock:
        said = said | F.contains(hook, F.lit(phrase))
    branded = F.exists("tags", lambda t: F.lower(t).isin([b.lower() for b in brands]))
    poor = F.coalesce(F.char_length("title"), F.lit(0)) < 5
    scores = {
        "layout": segments.groupBy("video_id").agg(clip(100 - FAULTS["short"] * F.count_if(c("end_ms") - c("start_ms") < shortest)).alias("layout")),
        "crop": crops.groupBy("video_id").agg(clip(100 - FAULTS["ratio"] * F.count_if(ratio) - FAULTS["outside"] * F.count_if(outside)).alias("crop")),
        "hooks": hooks.groupBy("video_id").agg(clip(100.0 * F.countDistinct(hook) / F.count("*") - FAULTS["stock"] * F.count_if(said)).alias("hooks")),
        "metadata": metadata.groupBy("video_id").agg(clip(100 - FAULTS["brand"] * F.count_if(~F.coalesce(branded, F.lit(False))) - FAULTS["title"] * F.count_if(poor)).alias("metadata")),
    }
    d = videos.select("video_id").distinct()
    for name, score in scores.items():
        d = d.join(score, "video_id", "left").withColumn(name, F.coalesce(name, F.lit(50.0)))
    d = d.withColumn("overall", F.round((c("layout") + c("crop") + c("hooks") + c("metadata")) * 0.25, 2))
    grade = F.when(c("overall") >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        grade = grade.when(c("overall") >= least, name)
    return d.withColumn("grade", grade.otherwise("B"))


@query("agg_quality_grade", """with v as (select distinct video_id from fx_candidates), h as (select video_id, lower(trim(case when cand % 9 = 8 then 'Watch What Happens next' else topic_id || left(text, 14) end)) as hook, case when cand % 6 = 5 then ['#Other'] else ['#x', '#Timeloom'] end as tags, case when cand % 8 = 7 then 'abc' else text end as title from fx_candidates),
l as (select video_id, greatest(0.0, 100.0 - 10 * count(*) filter (where end_ms - start_ms < 1200)) as layout from fx_scenes group by all),
c as (select video_id, greatest(0.0, 100.0 - 15 * count(*) filter (where abs(case when h = 0 then 0.0 else w / h::double end - 9.0 / 16.0) > 0.02) - 25 * count(*) filter (where x < 0 or y < 0 or x + w > 1921 or y + h > 1081)) as crop from fx_samples where t_ms < 1000 and track_id % 10 < 3 group by all),
k as (select video_id, greatest(0.0, 100.0 * count(distinct hook) / count(*) - 10 * count(*) filter (where contains(hook, 'this changed everything') or contains(hook, 'watch what happens'))) as hooks,
  greatest(0.0, 100.0 - 15 * count(*) filter (where not list_contains(list_transform(tags, lambda t: lower(t)), '#timeloom')) - 20 * count(*) filter (where length(title) < 5)) as metadata from h group by all),
s as (select v.video_id, coalesce(layout, 50.0)::double as layout, coalesce(crop, 50.0)::double as crop, coalesce(hooks, 50.0)::double as hooks, coalesce(metadata, 50.0)::double as metadata from v left join l using (video_id) left join c using (video_id) left join k using (video_id)),
o as (select *, round((layout + crop + hooks + metadata) * 0.25, 2) as overall from s)
select *, case when overall >= 93 then 'A+' when overall >= 87 then 'A' when overall >= 80 then 'B+' else 'B' end as grade from o""")
def agg_quality_grade(fx_candidates, fx_scenes, fx_samples):
    c = F.col
    few = materialise(fx_candidates.select("video_id", "cand", "topic_id", "text"), "titled")  # read three times
    hooks = few.select("video_id", F.when(c("cand") % 9 == 8, "Watch What Happens next").otherwise(F.concat("topic_id", F.left("text", F.lit(14)))).alias("hook"))
    metadata = few.select("video_id", F.when(c("cand") % 6 == 5, F.array(F.lit("#Other"))).otherwise(F.array(F.lit("#x"), F.lit("#Timeloom"))).alias("tags"), F.when(c("cand") % 8 == 7, "abc").otherwise(c("text")).alias("title"))
    return quality_grades(few, fx_scenes, fx_samples.where("t_ms < 1000 and track_id % 10 < 3"), hooks, metadata, (1920, 1080), ["#timeloom"], ["this changed everything", "watch what happens"])


@query("agg_storage_breakdown", "select case when path like '%.mp4' then 'video' when path like '%.mp3' then 'audio' when path like '%.json' then 'data' else 'images' end as category, sum(length)::bigint as bytes, count(*) as files from fx_assets group by all")
def agg_storage_breakdown(fx_assets):
    kind = F.when(F.col("path").endswith(".mp4"), "video").when(F.col("path").endswith(".mp3"), "audio").when(F.col("path").endswith(".json"), "data").otherwise("images")
    return fx_assets.groupBy(kind.alias("category")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


@query("agg_project_storage", "select project, sum(length)::bigint as bytes from fx_assets group by all")
def agg_project_storage(fx_assets):
    return fx_assets.groupBy("project").agg(F.sum("length").alias("bytes"))


@query("agg_stage_status", "select stage, count(*) filter (where status = 'skipped') as skipped, count(*) as n, case when count(*) filter (where status = 'skipped') = 0 then 'enabled' when count(*) filter (where status = 'skipped') = count(*) then 'skipped' else 'mixed' end as state, arg_min(status, seq) as first_status from fx_progress group by all")
def agg_stage_status(fx_progress):
    k = F.count_if(F.col("status") == "skipped")
    return fx_progress.groupBy("stage").agg(k.alias("skipped"), F.count("*").alias("n"), F.when(k == 0, "enabled").when(k == F.count("*"), "skipped").otherwise("mixed").alias("state"), F.min_by("status", "seq").alias("first_status"))


@query("agg_project_totals", "select count(*) as projects, sum(clip_count)::bigint as clips, sum(storage_bytes)::bigint as bytes from fx_projects where contains(lower(name), '1')")
def agg_project_totals(fx_projects):
    return fx_projects.where(F.lower("name").contains("1")).agg(F.count("*").alias("projects"), F.sum("clip_count").alias("clips"), F.sum("storage_bytes").alias("bytes"))


@query("agg_retention_plan", "select p.job, case when p.status = 'failed' and p.clip_count = 0 then 'orphan_failed' else 'old' end as category, p.storage_bytes from fx_projects p left join (select distinct job from fx_progress where status = 'running') a on a.job = p.job where a.job is null and ((p.status = 'failed' and p.clip_count = 0) or (p.status = 'complete' and p.updated_at < timestamp '1998-01-01'))")
def agg_retention_plan(fx_projects, fx_progress):
    """Projects that a cleanup would take, but for active ones: a plan, nothing is deleted."""
    failed = (F.col("status") == "failed") & (F.col("clip_count") == 0)
    old = (F.col("status") == "complete") & (F.col("updated_at") < F.lit("1998-01-01").cast("timestamp"))
    active = fx_progress.where("status = 'running'").select("job").distinct()
    return fx_projects.where(failed | old).join(active, "job", "left_anti").select("job", F.when(failed, "orphan_failed").otherwise("old").alias("category"), "storage_bytes")


@query("agg_run_diagnostics", "select video_id, count(*) as n, avg(score) as mean_score, count(*) filter (where boundary < 60) as need_refinement from fx_candidates group by all")
def agg_run_diagnostics(fx_candidates):
    return fx_candidates.groupBy("video_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if(F.col("boundary") < 60).alias("need_refinement"))


@query("agg_distinct", "select video_id, count(distinct topic_id) as topics, string_agg(distinct topic_id, ',' order by topic_id) as names from fx_candidates group by all")
def agg_distinct(fx_candidates):
    return fx_candidates.groupBy("video_id").agg(F.countDistinct("topic_id").alias("topics"), F.array_join(F.sort_array(F.collect_set("topic_id")), ",").alias("names"))


#: Peak velocity, acceleration and jerk of a move by its easing, as multiples of distance over powers of the duration; and the least pan and zoom.
PEAKS = {"cubic": (1.5, 6.0, 12.0), "sine": (math.pi / 2, math.pi**2 / 2, math.pi**3 / 2)}
LEAST_PAN, LEAST_ZOOM = 12.0, 0.004


def motion_metrics(moves: DataFrame) -> DataFrame:
    """Peaks along x, y and zoom of moves (``dx, dy, dzoom, seconds, easing``: sine, else cubic) and whether they mean anything;
    a move lasts a quarter of a second at least."""
    s = F.greatest(F.lit(0.25), F.col("seconds"))
    out = moves
    for n, (name, digits) in enumerate((("velocity", 4), ("acceleration", 4), ("jerk", 5))):
        factor = F.when(F.col("easing") == "sine", F.lit(PEAKS["sine"][n])).otherwise(F.lit(PEAKS["cubic"][n]))
        power = s if n == 0 else s * s if n == 1 else s * s * s
        for axis in ("x", "y", "zoom"):
            out = out.withColumn(f"peak_{name}_{axis}", F.round(F.abs(f"d{axis}") * factor / power, digits))
    return out.withColumn("moving", (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) >= LEAST_PAN) | (F.abs("dzoom") >= LEAST_ZOOM))


@query("agg_motion_metrics", "with t as (select video_id, track_id, arg_max(x, t_ms) - arg_min(x, t_ms) as dx, arg_max(y, t_ms) - arg_min(y, t_ms) as dy, (arg_max(conf_pct, t_ms) - arg_min(conf_pct, t_ms)) / 1000.0 as dz, greatest(0.25, (max(t_ms) - min(t_ms)) / 1000.0) as s, case when track_id % 2 = 0 then 'sine' else 'cubic' end as easing from fx_samples group by all), f as (select *, case when easing = 'sine' then [pi() / 2, pi() * pi() / 2, pi() * pi() * pi() / 2] else [1.5, 6.0, 12.0] end as f from t) select video_id, track_id, easing, " + ", ".join(f"round(abs({d}) * f[{n}] / ({p}), {g}) as peak_{m}_{a}" for n, m, p, g in ((1, "velocity", "s", 4), (2, "acceleration", "s * s", 4), (3, "jerk", "s * s * s", 5)) for a, d in (("x", "dx"), ("y", "dy"), ("zoom", "dz"))) + f", sqrt(dx * dx + dy * dy) >= {LEAST_PAN} or abs(dz) >= {LEAST_ZOOM} as moving from f")
def agg_motion_metrics(fx_samples):
    """Each track's move from its first to its last position."""
    change = lambda v: F.max_by(v, "t_ms") - F.min_by(v, "t_ms")
    t = fx_samples.groupBy("video_id", "track_id").agg(change("x").alias("dx"), change("y").alias("dy"), (change("conf_pct") / 1000.0).alias("dzoom"), ((F.max("t_ms") - F.min("t_ms")) / 1000.0).alias("seconds"))
    return motion_metrics(t.withColumn("easing", F.when(F.col("track_id") % 2 == 0, "sine").otherwise("cubic"))).drop("dx", "dy", "dzoom", "seconds")


@query("agg_drift", "select video_id, track_id, min(case when abs(x - x0) > 5 then t_ms end) as first_drift_ms, max(x) - min(x) as span, max(abs(x + w / 2.0 - 960)) as off_centre from (select *, first_value(x) over (partition by video_id, track_id order by t_ms) as x0 from fx_samples) t group by all")
def agg_drift(fx_samples):
    x0 = F.first("x").over(Window.partitionBy("video_id", "track_id").orderBy("t_ms"))
    return fx_samples.withColumn("x0", x0).groupBy("video_id", "track_id").agg(F.min(F.when(F.abs(F.col("x") - F.col("x0")) > 5, F.col("t_ms"))).alias("first_drift_ms"), (F.max("x") - F.min("x")).alias("span"), F.max(F.abs(F.col("x") + F.col("w") / 2.0 - 960)).alias("off_centre"))


@query("udaf_upper_median", "select video_id, list_sort(list(w))[count(*) // 2 + 1] as upper_median from fx_samples group by all")
def udaf_upper_median(fx_samples):
    return fx_samples.groupBy("video_id").agg(upper_median(F.collect_list("w")).alias("upper_median"))


@query("udaf_weighted_median", "select track_id, min(y) as weighted_median from (select track_id, y, sum(w) over (partition by track_id order by y) as c, sum(w) over (partition by track_id) as t from fx_samples) s where c >= t / 2 group by all")
def udaf_weighted_median(fx_samples):
    return selected_median(fx_samples, ["track_id"], "y", "w")
