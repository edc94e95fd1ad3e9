"""Ordered folds and matching over detections: stabilising, hysteresis, subject switches, face tracks; crop scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from timeloom.functions import columns as C
from timeloom.plans.catalog import query


def stabilize_short(df: DataFrame, keys: list[str], order: str, label: str, ms: str, least: int) -> DataFrame:
    """Left to right, a row shorter than ``least`` takes the label of its longer neighbour (the left one as already changed,
    ties to it); so a run of short rows passes on what its first took."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(label).cast("long").alias("l"), F.col(ms).cast("long").alias("m"))))

    def step(out, i):
        r = lambda k: F.try_element_at(F.col("r"), (i + k).cast("int"))
        left = F.element_at(out, -1)
        longer = F.when(i == 1, r(1)["l"]).when(i == F.size("r"), left).when(F.try_element_at(F.col("r"), F.greatest(i - 1, F.lit(1)))["m"] >= r(1)["m"], left).otherwise(r(1)["l"])
        take = F.when((r(0)["m"] < least) & (F.size("r") > 1), longer).otherwise(r(0)["l"])
        return F.array_append(out, take)

    g = df.groupBy(*keys).agg(rows.alias("r"))
    g = g.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.size("r")), F.array().cast("array<bigint>"), step))
    return g.select(*keys, F.explode(F.arrays_zip("r", "s")).alias("z")).select(*keys, F.col("z.r.o").alias(order), F.col("z.s").alias(label))


@query("win_short_stabilize", """with recursive o as (select video_id, scene_idx, (scene_idx * 7 + video_id) % 3 as l, end_ms - start_ms as m, row_number() over w as n, count(*) over (partition by video_id) as size, lag(end_ms - start_ms) over w as pm, lead(end_ms - start_ms) over w as nm, lead((scene_idx * 7 + video_id) % 3) over w as nl from fx_scenes window w as (partition by video_id order by scene_idx)),
g as (select video_id, n, case when m < 9000 and size > 1 then nl else l end as s from o where n = 1 union all select g.video_id, o.n, case when o.m < 9000 and o.size > 1 then case when o.n = o.size or o.pm >= o.nm then g.s else o.nl end else o.l end from g join o on o.video_id = g.video_id and o.n = g.n + 1)
select o.video_id, o.scene_idx, g.s::bigint as label from o join g using (video_id, n)""")
def win_short_stabilize(fx_scenes):
    d = fx_scenes.withColumns({"label": (F.col("scene_idx") * 7 + F.col("video_id")) % 3, "m": F.col("end_ms") - F.col("start_ms")})
    return stabilize_short(d, ["video_id"], "scene_idx", "label", "m", 9000)


@query("score_face_match", "select a.video_id, a.event_id as a, b.event_id as b, 0.55 * (greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) / greatest(1, a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) + 0.25 * greatest(0.0, 1.0 - sqrt(pow(a.x + a.w / 2.0 - b.x - b.w / 2.0, 2.0) + pow(a.y + a.h / 2.0 - b.y - b.h / 2.0, 2.0)) / 400.0) as score from fx_samples a join fx_samples b on a.video_id = b.video_id and a.track_id = b.track_id and b.t_ms = a.t_ms + 500")
def score_face_match(fx_samples):
    """Box overlap and closeness of two detections half a second apart."""
    a, b = fx_samples.alias("a"), fx_samples.withColumn("t_ms", F.col("t_ms") - 500).alias("b")
    j = a.join(b, [F.col("a.video_id") == F.col("b.video_id"), F.col("a.track_id") == F.col("b.track_id"), F.col("a.t_ms") == F.col("b.t_ms")])
    p, q = ({k: F.col(f"{s}.{k}") for k in "xywh"} for s in "ab")
    far = F.sqrt(F.pow(p["x"] + p["w"] / 2.0 - q["x"] - q["w"] / 2.0, 2.0) + F.pow(p["y"] + p["h"] / 2.0 - q["y"] - q["h"] / 2.0, 2.0))
    cut = F.greatest(F.lit(0), F.least(p["x"] + p["w"], q["x"] + q["w"]) - F.greatest(p["x"], q["x"])) * F.greatest(F.lit(0), F.least(p["y"] + p["h"], q["y"] + q["h"]) - F.greatest(p["y"], q["y"]))
    score = F.lit(0.55) * cut / F.greatest(F.lit(1), p["w"] * p["h"] + q["w"] * q["h"] - cut) + F.lit(0.25) * F.greatest(F.lit(0.0), 1.0 - far / 400.0)
    return j.select(F.col("a.video_id").alias("video_id"), F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), score.alias("score"))


@query("score_crop_quality", "select event_id, greatest(0.0, least(1.0, 0.25 * (conf_pct / 100.0) + 0.30 * (case when x >= 0 and x + w <= 608 then 1.0 else 0.5 end) + 0.20 * least(1.0, w * h / 100000.0) + 0.15 * (1.0 - y / 300.0) + 0.10)) as score from fx_samples")
def score_crop_quality(fx_samples):
    c = F.col
    inside = F.when((c("x") >= 0) & (c("x") + c("w") <= 608), 1.0).otherwise(0.5)
    return fx_samples.select("event_id", C.clamp(0.25 * (c("conf_pct") / 100.0) + 0.30 * inside + 0.20 * F.least(F.lit(1.0), c("w") * c("h") / 100000.0) + 0.15 * (1.0 - c("y") / 300.0) + 0.10, 0.0, 1.0).alias("score"))


@query("score_composition", "select event_id, 0.4 * (1.0 - abs(y / 1080.0 - 0.12)) + 0.3 * (1.0 - abs((y + h * 0.2) / 1080.0 - 0.33)) + 0.3 * (case when (x + w / 2.0) / 1920.0 between 0.1 and 0.9 then 1.0 else 0.0 end) as score, not ((x + w / 2.0) / 1920.0 between 0.1 and 0.9) as breach from fx_samples")
def score_composition(fx_samples):
    """Headroom, eye line and edge safety; a breach is a centre outside 10 to 90 %."""
    c = F.col
    centre = (c("x") + c("w") / 2.0) / 1920.0
    safe = centre.between(0.1, 0.9)
    return fx_samples.select("event_id", (0.4 * (1.0 - F.abs(c("y") / 1080.0 - 0.12)) + 0.3 * (1.0 - F.abs((c("y") + c("h") * 0.2) / 1080.0 - 0.33)) + 0.3 * F.when(safe, 1.0).otherwise(0.0)).alias("score"), (~safe).alias("breach"))


#: Shares of overlap, closeness and likeness in a match, the least score, and how long a track waits for its next face.
MATCH, LEAST_MATCH, TRACK_GAP_MS = (0.55, 0.25, 0.20), 0.48, 2000


def match_score(a: dict, b: dict) -> float:
    """How well two faces match: overlap of boxes, closeness of centres against the boxes' mean side, likeness of appearance
    (a half where one is unknown). Of faces that can't reach LEAST_MATCH the appearance isn't looked at."""
    w = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    far = math.hypot(a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2, a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2) / max(1, (a["w"] + a["h"] + b["w"] + b["h"]) / 4)
    place = MATCH[0] * (w * h / union if union > 0 else 0.0) + MATCH[1] * max(0.0, 1 - far)
    if place + MATCH[2] < LEAST_MATCH:  # too far apart whatever they look like
        return place
    u, v = a["appearance"], b["appearance"]
    size = math.sqrt(squares(a) * squares(b)) if u and v and len(u) == len(v) else 0.0
    like = max(0.0, min(1.0, sum(p * q for p, q in zip(u, v)) / size)) if size else 0.5
    return place + MATCH[2] * like


def squares(face: dict) -> float:
    """The sum of the squares of an appearance, which is kept with the face."""
    if "squares" not in face:
        face["squares"] = sum(p * p for p in face["appearance"])
    return face["squares"]


class FaceTracks:
    """Table function over the faces of a scene, sorted by time and, within a frame, from the surest and largest on: each joins the best track that
    another frame within TRACK_GAP_MS left (one face of a frame each; ties to the older track), or opens one. Only such
    tracks are held, however long the scene."""

    def __init__(self):
        self.waiting: dict[int, dict] = {}
        self.opened = 0

    def eval(self, row):
        face = row.asDict()
        t = face["t_ms"]
        self.waiting = {k: v for k, v in self.waiting.items() if t - v["t_ms"] <= TRACK_GAP_MS}
        score, k = max(((match_score(v, face), -k) for k, v in self.waiting.items() if v["t_ms"] < t), default=(0.0, 0))
        track = -k
        if score < LEAST_MATCH:
            track = self.opened
            self.opened += 1
        self.waiting[track] = face
        yield face["video_id"], face["scene"], face["event_id"], track, t


def face_tracks(detections: DataFrame) -> DataFrame:
    """``video_id, scene, event_id, track, t_ms`` of faces (``video_id, scene, event_id, t_ms, x, y, w, h, weight, appearance``), tracks numbered
    from 0 in each scene. Spark partitions by scene and sorts; the table function sees one row after the other."""
    of = F.udtf(FaceTracks, returnType=f"video_id long, scene long, event_id long, track int, t_ms {detections.schema['t_ms'].dataType.simpleString()}")
    return of(detections.asTable().partitionBy("video_id", "scene").orderBy(F.col("t_ms"), F.desc("weight"), F.col("event_id")))


def faces(samples: DataFrame, embeddings: DataFrame) -> DataFrame:
    look = embeddings.select(F.col("vec_id").alias("k"), F.slice("embedding", 1, 16).cast("array<double>").alias("appearance"))
    s = samples.withColumns({"k": F.col("event_id") % 200, "scene": F.floor(F.col("t_ms") / 5000), "w": F.floor(F.col("w") / 4), "h": F.floor(F.col("h") / 5)})
    s = s.withColumn("weight", F.col("conf_pct") * F.col("w") * F.col("h"))
    return s.join(look, "k").select("video_id", "scene", "event_id", "t_ms", "x", "y", "w", "h", "weight", "appearance")


_SCORE = """0.55 * (case when z.u > 0 then z.o / z.u::double else 0.0 end) + 0.25 * greatest(0.0, 1 - sqrt(pow(t.x + t.w / 2.0 - d.x - d.w / 2.0, 2.0) + pow(t.y + t.h / 2.0 - d.y - d.h / 2.0, 2.0)) / greatest(1.0, (t.w + t.h + d.w + d.h) / 4.0)) + 0.2 * greatest(0.0, least(1.0, list_inner_product(t.app, d.app) / sqrt(list_inner_product(t.app, t.app) * list_inner_product(d.app, d.app))))"""
_OVERLAP = "(greatest(0, least(t.x + t.w, d.x + d.w) - greatest(t.x, d.x)) * greatest(0, least(t.y + t.h, d.y + d.h) - greatest(t.y, d.y)))"
_FACES = f"""fc as (select s.video_id, s.t_ms // 5000 as scene, s.event_id, s.t_ms, s.x, s.y, s.w // 4 as w, s.h // 5 as h, s.conf_pct * (s.w // 4) * (s.h // 5) as weight, e.embedding[1:16]::double[] as app from fx_samples s join embeddings e on e.vec_id = s.event_id % 200),
o as materialized (select *, row_number() over (partition by video_id, scene order by t_ms, weight desc, event_id) as n from fc),
ft as (select video_id, scene, 0::bigint as n, null::bigint as event_id, null::int as track, []::struct(x bigint, y bigint, w bigint, h bigint, t_ms bigint, app double[])[] as held from o where n = 1
  union all select f.video_id, f.scene, d.n, d.event_id, (case when q.best >= 0.48 then q.pos - 1 else len(f.held) end)::int,
    case when q.best >= 0.48 then f.held[1:q.pos - 1] || [q.own] || f.held[q.pos + 1:] else list_append(f.held, q.own) end
  from ft f join o d on d.video_id = f.video_id and d.scene = f.scene and d.n = f.n + 1,
    lateral (select list_transform(f.held, lambda t: case when d.t_ms - t.t_ms > 0 and d.t_ms - t.t_ms <= 2000 then {_SCORE.replace('z.o', _OVERLAP).replace('z.u', f'(t.w * t.h + d.w * d.h - {_OVERLAP})')} else -1.0 end) as scores, {{'x': d.x::bigint, 'y': d.y::bigint, 'w': d.w::bigint, 'h': d.h::bigint, 't_ms': d.t_ms::bigint, 'app': d.app}} as own) r,
    lateral (select coalesce(list_max(r.scores), -1.0) as best, list_position(r.scores, list_max(r.scores)) as pos, r.own) q)"""


@query("win_face_tracking", f"with recursive {_FACES} select video_id, scene, event_id, track from ft where n > 0")
def win_face_tracking(fx_samples, embeddings):
    return face_tracks(faces(fx_samples, embeddings)).drop("t_ms")


@query("udtf_face_tracks", f"with recursive {_FACES} select ft.video_id, ft.scene, track, count(*) as n, min(t_ms) as start_ms, max(t_ms) as end_ms from ft join o using (video_id, scene, n) where ft.n > 0 group by ft.video_id, ft.scene, track")
def udtf_face_tracks(fx_samples, embeddings):
    """Tracks as a table: members and span of each."""
    return face_tracks(faces(fx_samples, embeddings)).groupBy("video_id", "scene", "track").agg(F.count("*").alias("n"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"))


PROFILES = {"crowd": (0.5, 2), "dynamic": (0.8, 1), "static": (0.2, 3)}


@query("udf_profile_override", "select video_id, coalesce(case when video_id % 4 = 0 then 'static' end, case when n > 400 then 'crowd' else 'dynamic' end) as profile, case coalesce(case when video_id % 4 = 0 then 'static' end, case when n > 400 then 'crowd' else 'dynamic' end) when 'crowd' then 0.5 when 'dynamic' then 0.8 else 0.2 end as speed from (select video_id, count(*) as n from fx_samples group by all) t")
def udf_profile_override(fx_samples):
    """A caller's profile, else the classifier's, with its parameters."""
    n = fx_samples.groupBy("video_id").agg(F.count("*").alias("n"))
    p = F.coalesce(F.when(F.col("video_id") % 4 == 0, "static"), F.when(F.col("n") > 400, "crowd").otherwise("dynamic"))
    speed = F.lit(None).cast("double")
    for k, (v, _) in PROFILES.items():
        speed = F.when(F.col("profile") == k, F.lit(v)).otherwise(speed)
    return n.select("video_id", p.alias("profile")).withColumn("speed", speed)


@query("gen_keyframe_trace", "select video_id, track_id, k::int as point, case k when 0 then a when 1 then (a + z) / 2.0 else z::double end as t_ms, case k when 0 then x0 when 1 then x0 + (x1 - x0) * 0.5 else x1 end::double as x from (select video_id, track_id, min(t_ms) as a, max(t_ms) as z, arg_min(x, t_ms) as x0, arg_max(x, t_ms) as x1 from fx_samples group by all) t, range(3) r(k)")
def gen_keyframe_trace(fx_samples):
    """Each move at its start, middle (eased) and end."""
    t = fx_samples.groupBy("video_id", "track_id").agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("z"), F.min_by("x", "t_ms").alias("x0"), F.max_by("x", "t_ms").alias("x1"))
    at = lambda f: F.struct((F.col("a") + (F.col("z") - F.col("a")) * F.lit(f)).alias("t_ms"), (F.col("x0") + (F.col("x1") - F.col("x0")) * C.ease_cubic(F.lit(f))).alias("x"))
    return t.select("video_id", "track_id", F.posexplode(F.array(at(0.0), at(0.5), at(1.0))).alias("point", "p")).select("video_id", "track_id", "point", "p.t_ms", "p.x")


@query("gen_segment_pairs", "select v.video_id, coalesce(s.scene_idx, 0)::bigint as scene, coalesce(case (s.scene_idx + v.video_id) % 3 when 0 then 'crop' when 1 then 'pad' when 2 then 'split' end, 'crop') as layout, case coalesce((s.scene_idx + v.video_id) % 3, 0) when 0 then 1.2 else 1.0 end as zoom from (select distinct video_id from fx_words) v left join fx_scenes s using (video_id)")
def gen_segment_pairs(fx_words, fx_scenes):
    """A layout row per scene with its zoom; a default row where a video has none."""
    v = fx_words.select("video_id").distinct().join(fx_scenes.select("video_id", "scene_idx"), "video_id", "left")
    k = (F.col("scene_idx") + F.col("video_id")) % 3
    return v.select("video_id", F.coalesce("scene_idx", F.lit(0)).cast("long").alias("scene"), F.coalesce(F.when(k == 0, "crop").when(k == 1, "pad").when(k == 2, "split"), F.lit("crop")).alias("layout"), F.when(F.coalesce(k, F.lit(0)) == 0, 1.2).otherwise(1.0).alias("zoom"))
