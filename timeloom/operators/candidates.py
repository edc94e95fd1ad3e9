"""Candidate windows: generation, scores, suppression, merging, duplicates, ranking and selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from timeloom.functions import columns as C
from timeloom.operators.duplicates import linked_in_tasks
from timeloom.operators.graph import connected_components
from timeloom.operators.intervals import BIN_MS, _dealt, as_right, interval_join, snap_scene, snap_speech
from timeloom.operators.windows import sentence_snap
from timeloom.plans.catalog import query
from timeloom.plans.scratch import materialise

HOOKS = [*C.HOOK_WORDS, "that", "only", "was"]


def hook_hits(text, hooks: Sequence[str] = HOOKS) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(*hooks)))


def segment_windows(segments: DataFrame, min_ms: int, max_ms: int, hooks: Sequence[str] = HOOKS) -> DataFrame:
    """All runs of consecutive segments lasting ``min_ms`` to ``max_ms`` (or a single longer one), with counts of words,
    hook words and question or exclamation marks from prefix sums: no text is joined for windows that lose later. Each segment
    meets those that begin within ``max_ms`` after it in a frame of its video, so nothing is shuffled or read twice. Adds ``video_ms``."""
    video = Window.partitionBy("video_id")
    w = video.orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    s = segments.withColumns({"_h": hook_hits("text", hooks), "_m": F.col("text").rlike("[?!]").cast("int"), "video_ms": F.max("end_ms").over(video)})
    s = s.withColumns({k: F.sum(c).over(w) for k, c in (("cw", "word_count"), ("ch", "_h"), ("cm", "_m"))})
    s = s.select("video_id", "video_ms", F.col("seg_idx").alias("first_seg"), F.col("start_ms").cast("long").alias("start_ms"), "end_ms", "cw", "ch", "cm", *[(F.col(c) - F.col(o)).alias(b) for c, o, b in (("cw", "word_count", "bw"), ("ch", "_h", "bh"), ("cm", "_m", "bm"))])
    ahead = F.collect_list(F.struct(F.col("first_seg").alias("last_seg"), "end_ms", "cw", "ch", "cm")).over(video.orderBy("start_ms").rangeBetween(0, max_ms))
    j = s.withColumn("_ahead", ahead).select("video_id", "video_ms", "first_seg", "start_ms", "bw", "bh", "bm", F.explode("_ahead").alias("x"))
    ms = F.col("x.end_ms") - F.col("start_ms")
    j = j.where((ms >= min_ms) & ((ms <= max_ms) & (F.col("x.last_seg") >= F.col("first_seg")) | (F.col("x.last_seg") == F.col("first_seg"))))
    return j.select("video_id", "first_seg", "x.last_seg", "start_ms", "x.end_ms", (F.col("x.cw") - F.col("bw")).alias("word_count"), (F.col("x.ch") - F.col("bh")).alias("hooks"), (F.col("x.cm") - F.col("bm") > 0).alias("marked"), "video_ms")


def candidate_score(hooks: Column, words: Column, ms: Column, start: Column, video_ms: Column, marked: Column) -> Column:
    """Hook words, speech density, fit to 30 s, position and punctuation; 1 to 100 with two places, rounded half up."""
    raw = hooks * 8 + F.least(words / F.greatest(ms / 1000.0, F.lit(1.0)), F.lit(4.0)) * 12 + F.greatest(1 - F.abs(ms / 1000.0 - 30) / 30, F.lit(0.0)) * 25 + (1 - F.least(start / F.greatest(video_ms, F.lit(1000)), F.lit(1.0))) * 10 + F.when(marked, 10).otherwise(0)
    return C.clamp(F.floor(raw * 100 + 0.5) / 100.0, 1.0, 100.0)


def scored_windows(segments: DataFrame, min_ms: int = 20_000, max_ms: int = 60_000) -> DataFrame:
    score = candidate_score(F.col("hooks"), F.col("word_count"), F.col("end_ms") - F.col("start_ms"), F.col("start_ms"), F.col("video_ms"), F.col("marked"))
    return segment_windows(segments, min_ms, max_ms).withColumn("score", score)


_HOOK_SQL = ", ".join(f"'{h}'" for h in HOOKS)
_WIN = f"""p as (select *, sum(word_count) over w as cw, sum(h) over w as ch, sum(m) over w as cm from (select *, len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: x in ({_HOOK_SQL}))) as h, case when regexp_matches(text, '[?!]') then 1 else 0 end as m from fx_segments) s window w as (partition by video_id order by seg_idx)),
c as (select a.video_id, a.seg_idx as first_seg, b.seg_idx as last_seg, a.start_ms, b.end_ms, (b.cw - a.cw + a.word_count)::bigint as word_count, (b.ch - a.ch + a.h)::bigint as hooks, b.cm - a.cm + a.m > 0 as marked from p a join p b on a.video_id = b.video_id and b.seg_idx >= a.seg_idx and (b.end_ms - a.start_ms <= 60000 or a.seg_idx = b.seg_idx) and b.end_ms - a.start_ms >= 20000),
sc as (select c.*, v.video_ms, greatest(1.0, least(100.0, floor((hooks * 8 + least(word_count / greatest((c.end_ms - c.start_ms) / 1000.0, 1.0), 4.0) * 12 + greatest(1 - abs((c.end_ms - c.start_ms) / 1000.0 - 30) / 30, 0.0) * 25 + (1 - least(c.start_ms / greatest(v.video_ms, 1000), 1.0)) * 10 + case when marked then 10 else 0 end) * 100 + 0.5) / 100.0)) as score from c join (select video_id, max(end_ms) as video_ms from fx_segments group by all) v using (video_id))"""


@query("gen_segment_windows", f"with {_WIN} select * from c")
def gen_segment_windows(fx_segments):
    return segment_windows(fx_segments, 20_000, 60_000).drop("video_ms")


@query("score_candidate", f"with {_WIN} select video_id, first_seg, last_seg, score from sc")
def score_candidate(fx_segments):
    return scored_windows(fx_segments).select("video_id", "first_seg", "last_seg", "score")


@query("topk_highlights", f"with {_WIN} select video_id, first_seg, last_seg, score, n from (select *, row_number() over (partition by video_id order by score desc, first_seg, last_seg) as n from sc) t where n <= 5")
def topk_highlights(fx_segments):
    w = Window.partitionBy("video_id").orderBy(F.desc("score"), "first_seg", "last_seg")
    return scored_windows(fx_segments).withColumn("n", F.row_number().over(w)).where("n <= 5").select("video_id", "first_seg", "last_seg", "score", "n")


def greedy_keep(df: DataFrame, keys: list[str], order: list[Column], payload: list[str], conflict: Callable[[Column, Column], Column], limit: int | None = None) -> DataFrame:
    """Per group, rows in order; a row that conflicts with a kept one is dropped, until ``limit`` are kept.

    One fold over the group's sorted array of small structs: bounded by a video's candidates, not by its words."""
    names = [f"_o{i}" for i in range(len(order))]
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(n) for n, o in zip(names, order)], *payload)))
    kind = df.select(F.array(F.struct(*payload))).schema[0].dataType

    def step(kept, r):
        clash = F.exists(kept, lambda k: conflict(k, r))
        full = F.size(kept) >= limit if limit else F.lit(False)
        return F.when(full | clash, kept).otherwise(F.array_append(kept, F.struct(*[r[p].alias(p) for p in payload])))

    folded = df.groupBy(*keys).agg(rows.alias("_r")).withColumn("_k", F.aggregate("_r", F.array().cast(kind), step))
    return folded.select(*keys, F.posexplode("_k").alias("kept", "_x")).select(*keys, "kept", "_x.*")


def overlap_share(limit: float) -> Callable[[Column, Column], Column]:
    """Conflict by more than a share of the shorter."""
    return lambda k, r: F.least(k["end_ms"], r["end_ms"]) - F.greatest(k["start_ms"], r["start_ms"]) > F.least(k["end_ms"] - k["start_ms"], r["end_ms"] - r["start_ms"]) * F.lit(limit)


def nms_sql(source: str, order: str, clash: str, limit: int = 1000) -> str:
    """Greedy suppression as a recursive query over (video_id, cand, start_ms, end_ms)."""
    hit = f"len(g.kept) >= {limit} or len(list_filter(g.kept, lambda k: {clash})) > 0"
    row = "{'c': t.cand, 's': t.start_ms, 'e': t.end_ms}"
    return f"""o as (select video_id, cand, start_ms, end_ms, row_number() over (partition by video_id order by {order}) as n from {source}),
g as (select t.video_id, t.n, [{row}] as kept from o t where n = 1 union all select g.video_id, t.n, case when {hit} then g.kept else list_append(g.kept, {row}) end from g join o t on t.video_id = g.video_id and t.n = g.n + 1),
r as (select video_id, unnest(kept) as k, unnest(range(len(kept))) as kept from (select video_id, arg_max(kept, n) as kept from g group by all) x)"""


_CLASH = "least(k.e, t.end_ms) - greatest(k.s, t.start_ms)"


@query("nms_overlap35", f"with recursive {nms_sql('fx_candidates', 'score desc, cand', _CLASH + ' > least(k.e - k.s, t.end_ms - t.start_ms) * 0.35')} select video_id, kept::int as kept, k.c as cand from r")
def nms_overlap35(fx_candidates):
    """By score; over 35 % of the shorter is too much."""
    return greedy_keep(fx_candidates, ["video_id"], [-F.col("score"), F.col("cand")], ["cand", "start_ms", "end_ms"], overlap_share(0.35)).select("video_id", "kept", "cand")


@query("nms_iou_hull", f"with recursive {nms_sql('fx_candidates', 'retention desc, cand', 'greatest(0, ' + _CLASH + ') / greatest(100, greatest(k.e, t.end_ms) - least(k.s, t.start_ms)) > 0.35')} select video_id, kept::int as kept, k.c as cand from r")
def nms_iou_hull(fx_candidates):
    clash = lambda k, r: C.iou_hull(k["start_ms"], k["end_ms"], r["start_ms"], r["end_ms"]) > 0.35
    return greedy_keep(fx_candidates, ["video_id"], [-F.col("retention"), F.col("cand")], ["cand", "start_ms", "end_ms"], clash).select("video_id", "kept", "cand")


@query("nms_any_overlap", f"with recursive {nms_sql('fx_candidates', 'score desc, cand', _CLASH + ' > 0', 3)} select video_id, kept::int as kept, k.c as cand from r")
def nms_any_overlap(fx_candidates):
    clash = lambda k, r: (r["start_ms"] < k["end_ms"]) & (r["end_ms"] > k["start_ms"])
    return greedy_keep(fx_candidates, ["video_id"], [-F.col("score"), F.col("cand")], ["cand", "start_ms", "end_ms"], clash, 3).select("video_id", "kept", "cand")


def merge_overlaps_of(df: DataFrame, max_ms: int) -> DataFrame:
    """By start: a clip over 30 % of the shorter into its predecessor is merged with it if both fit into ``max_ms``, else the
    better of the two stays."""
    fields = ["start_ms", "end_ms", "score", "cand", "n"]
    d = df.select("video_id", *[F.col(c).cast("double" if c == "score" else "long").alias(c) for c in fields[:-1]], F.lit(1).cast("long").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("start_ms", "cand", "end_ms", "score", "n")))
    kind = d.select(F.array(F.struct(*fields))).schema[0].dataType
    pack = lambda **v: F.struct(*[v[f].alias(f) for f in fields])

    def step(m, r):
        last = F.element_at(m, -1)
        own = pack(**{f: r[f] for f in fields})
        head = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
        s, e = F.least(last["start_ms"], r["start_ms"]), F.greatest(last["end_ms"], r["end_ms"])
        clash = overlap_share(0.30)(last, r)
        both = pack(start_ms=s, end_ms=e, score=F.greatest(last["score"], r["score"]), cand=last["cand"], n=last["n"] + 1)
        better = F.when(r["score"] > last["score"], F.array_append(head, own)).otherwise(m)
        return F.when(F.size(m) == 0, F.array_append(m, own)).when(~clash, F.array_append(m, own)).when(e - s <= max_ms, F.array_append(head, both)).otherwise(better)

    return d.groupBy("video_id").agg(F.aggregate(rows, F.array().cast(kind), step).alias("m")).select("video_id", F.explode("m").alias("x")).select("video_id", "x.*")


@query("merge_overlaps", """with recursive o as (select video_id, cand, start_ms::bigint as s, end_ms::bigint as e, score::double as score, row_number() over (partition by video_id order by start_ms, cand) as n from fx_candidates),
g as (select video_id, n, []::struct(s bigint, e bigint, score double, c bigint, n bigint)[] as done, {'s': s, 'e': e, 'score': score, 'c': cand::bigint, 'n': 1::bigint} as last from o where n = 1
 union all select g.video_id, t.n, case when x.clash then g.done else list_append(g.done, g.last) end,
  case when not x.clash or (not x.fits and t.score > g.last.score) then {'s': t.s, 'e': t.e, 'score': t.score, 'c': t.cand::bigint, 'n': 1::bigint} when x.fits then {'s': least(g.last.s, t.s), 'e': greatest(g.last.e, t.e), 'score': greatest(g.last.score, t.score), 'c': g.last.c, 'n': g.last.n + 1} else g.last end
  from g join o t on t.video_id = g.video_id and t.n = g.n + 1, lateral (select least(g.last.e, t.e) - greatest(g.last.s, t.s) > least(g.last.e - g.last.s, t.e - t.s) * 0.30 as clash, greatest(g.last.e, t.e) - least(g.last.s, t.s) <= 60000 as fits) x),
f as (select video_id, unnest(l) as k from (select video_id, list_append(arg_max(done, n), arg_max(last, n)) as l from g group by video_id) x)
select video_id, k.s as start_ms, k.e as end_ms, k.score as score, k.c as cand, k.n as n from f""")
def merge_overlaps(fx_candidates):
    return merge_overlaps_of(fx_candidates, 60_000)


def zone_picks(cands: DataFrame, limit: int = 5, long_ms: int = 600_000, long_zone_ms: int = 300_000, zone_ms: int = 120_000) -> DataFrame:
    """Clips that cover a whole video: ``video_id, kept, cand, zone, filled``.

    Zone by zone (five minutes in videos of ten and more, else two) the best candidate that overlaps none chosen before by more
    than 35 % of the shorter; a zone may stay empty. While fewer than ``limit`` are chosen, the best of the video's other candidates
    follow by the same rule (``filled``). Ties go to the smaller ``cand``. Two folds over a video's candidates in one pass; what is kept is at most ``limit``."""
    total = Window.partitionBy("video_id")
    c = cands.where("start_ms is not null and end_ms is not null and score is not null").withColumn("_z", F.when(F.max("end_ms").over(total) >= long_ms, long_zone_ms).otherwise(zone_ms))
    fields = ["cand", "start_ms", "end_ms", "zone"]
    row = F.struct(F.floor(F.col("start_ms") / F.col("_z")).alias("zone"), (-F.col("score")).alias("_o"), "cand", "start_ms", "end_ms")
    one = c.select(F.struct("cand", "start_ms", "end_ms", F.lit(0).cast("long").alias("zone"), F.lit(False).alias("filled")).alias("x"))
    kind = one.select(F.struct(F.array("x").alias("kept"), F.lit(0).cast("long").alias("done"))).schema[0].dataType.simpleString()

    def taken(s, r, filled):
        return F.array_append(s["kept"], F.struct(*[r[f].alias(f) for f in fields], F.lit(filled).alias("filled")))

    def free(s, r):
        return (F.size(s["kept"]) < limit) & ~F.exists(s["kept"], lambda k: overlap_share(0.35)(k, r))

    def by_zone(s, r):
        fits = (s["done"].isNull() | (s["done"] != r["zone"])) & free(s, r)
        return F.when(fits, F.struct(taken(s, r, False).alias("kept"), r["zone"].alias("done"))).otherwise(s).cast(kind)

    def by_score(s, r):
        return F.when(free(s, r), F.struct(taken(s, r, True).alias("kept"), s["done"].alias("done"))).otherwise(s).cast(kind)

    g = c.groupBy("video_id").agg(F.sort_array(F.collect_list(row)).alias("_r"))
    start = F.struct(F.array().alias("kept"), F.lit(None).cast("long").alias("done")).cast(kind)
    ranked = F.array_sort("_r", lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).when(a["cand"] < b["cand"], -1).when(a["cand"] > b["cand"], 1).otherwise(0))
    g = g.withColumn("_s", F.aggregate("_r", start, by_zone)).withColumn("_s", F.aggregate(ranked, F.col("_s"), by_score))
    return g.select("video_id", F.posexplode("_s.kept").alias("kept", "x")).select("video_id", "kept", "x.cand", "x.zone", "x.filled")


@query("win_zone_top1", f"""with recursive z as (select *, start_ms // case when max(end_ms) over (partition by video_id) >= 600000 then 300000 else 120000 end as zone from fx_candidates),
u as (select *, false as filled from z union all select *, true as filled from z), o as (select *, row_number() over (partition by video_id order by filled, case when not filled then zone end, score desc, cand) as n from u),
g as (select video_id, n, [{{'c': cand, 's': start_ms, 'e': end_ms, 'z': zone, 'f': false}}] as kept from o where n = 1
 union all select g.video_id, t.n, case when len(g.kept) >= 5 or (not t.filled and g.kept[-1].z = t.zone) or len(list_filter(g.kept, lambda k: {_CLASH} > least(k.e - k.s, t.end_ms - t.start_ms) * 0.35)) > 0 then g.kept else list_append(g.kept, {{'c': t.cand, 's': t.start_ms, 'e': t.end_ms, 'z': t.zone, 'f': t.filled}}) end from g join o t on t.video_id = g.video_id and t.n = g.n + 1)
select video_id, i::int as kept, kept[i + 1].c as cand, kept[i + 1].z::bigint as zone, kept[i + 1].f as filled from (select video_id, kept, unnest(range(len(kept))) as i from (select video_id, arg_max(kept, n) as kept from g group by video_id) x) y""")
def win_zone_top1(fx_candidates):
    return zone_picks(fx_candidates)


@query("gen_zone_labels", "select video_id, string_agg((z * 2)::varchar || '-' || (z * 2 + 2)::varchar || 'min', ', ' order by z) as zones from (select video_id, unnest(range(0, (max(end_ms) // 120000)::bigint + 1)) as z from fx_segments group by video_id) t group by all")
def gen_zone_labels(fx_segments):
    z = F.sequence(F.lit(0).cast("long"), F.floor(F.max("end_ms") / 120_000))
    return fx_segments.groupBy("video_id").agg(F.array_join(F.transform(z, lambda i: F.concat((i * 2).cast("string"), F.lit("-"), (i * 2 + 2).cast("string"), F.lit("min"))), ", ").alias("zones"))


@query("gen_fallback_windows", "with v as (select video_id, max(end_ms) as last from fx_words group by all), w as (select video_id, i, (i * greatest(5000, last // 4))::bigint as a, least((i + 1) * greatest(5000, last // 4), last)::bigint as z, 60 - i as score from v, range(4) t(i) where i * greatest(5000, last // 4) < last) select w.video_id, w.i::int as i, a as start_ms, z as end_ms, score::int as score, count(x.idx) as words from w left join fx_words x on x.video_id = w.video_id and x.start_ms >= a and x.end_ms <= z group by all")
def gen_fallback_windows(fx_words):
    """Four fixed windows of five seconds at least with the words inside them."""
    v = fx_words.groupBy("video_id").agg(F.max("end_ms").alias("last"))
    step = F.greatest(F.lit(5000), F.floor(F.col("last") / 4))
    w = v.select("video_id", "last", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).where(F.col("i") * F.col("step") < F.col("last"))
    w = w.select("video_id", "i", (F.col("i") * F.col("step")).alias("start_ms"), F.least((F.col("i") + 1) * F.col("step"), "last").alias("end_ms"), (60 - F.col("i")).alias("score"))
    n = interval_join(w, as_right(fx_words, idx="idx"), "contained").groupBy("video_id", "i").agg(F.count("*").alias("words"))
    return w.join(n, ["video_id", "i"], "left").select("video_id", "i", "start_ms", "end_ms", "score", F.coalesce("words", F.lit(0)).alias("words"))


@query("gen_fallback_segments", f"""with recursive f as (select a.video_id, a.seg_idx as cand, a.start_ms, min(b.end_ms) as end_ms from fx_segments a join fx_segments b on b.video_id = a.video_id and b.seg_idx >= a.seg_idx and b.end_ms - a.start_ms >= 8000 and b.end_ms - a.start_ms <= 20000 group by all), {nms_sql('f', 'start_ms, cand', _CLASH + ' > 0')} select video_id, kept::int as kept, k.c as cand, k.e as end_ms from r""")
def gen_fallback_segments(fx_segments):
    """Each segment extended forward to 8 s, at most 20 s, then those that don't overlap an earlier one."""
    a = fx_segments.select("video_id", F.col("seg_idx").alias("cand"), "start_ms", (F.col("start_ms") + 20_000).alias("end_ms"))
    b = fx_segments.select("video_id", F.col("seg_idx").alias("last"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    f = interval_join(a, b, "contained").where("last >= cand and r_end - start_ms >= 8000").groupBy("video_id", "cand", "start_ms").agg(F.min("r_end").alias("end_ms"))
    clash = lambda k, r: (r["start_ms"] < k["end_ms"]) & (r["end_ms"] > k["start_ms"])
    return greedy_keep(f, ["video_id"], [F.col("start_ms"), F.col("cand")], ["cand", "start_ms", "end_ms"], clash).select("video_id", "kept", "cand", "end_ms")


def min_duration(clips: DataFrame, segments: DataFrame, target_ms: int, max_ms: int) -> DataFrame:
    """Clips shorter than the target grow by whole segments within the target around them, then by equal padding."""
    need = F.greatest(F.lit(0), target_ms - (F.col("end_ms") - F.col("start_ms")))
    c = clips.withColumns({"_id": F.monotonically_increasing_id(), "_need": need})
    around = c.select(*[k for k in c.columns if k not in ("start_ms", "end_ms", "_need")], F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), (F.col("start_ms") - F.col("_need")).alias("start_ms"), (F.col("end_ms") + F.col("_need")).alias("end_ms"))
    rows = interval_join(around, as_right(segments), "contained", "left").groupBy("_id")
    j = rows.agg(*[F.first(k).alias(k) for k in clips.columns if k not in ("start_ms", "end_ms")], F.first("_s").alias("start_ms"), F.first("_e").alias("end_ms"), F.min("r_start").alias("a"), F.max("r_end").alias("b")).drop("_id")
    s, e = F.least("start_ms", F.coalesce("a", "start_ms")), F.greatest("end_ms", F.coalesce("b", "end_ms"))
    pad = F.greatest(F.lit(0), target_ms - (e - s))
    s2 = F.greatest(F.lit(0), s - F.floor(pad / 2))
    return j.withColumns({"s": s2, "e": F.least(e + F.floor(pad / 2), s2 + max_ms)}).drop("a", "b")


@query("gen_min_duration", """with c as (select video_id, clip, start_ms, end_ms, greatest(0, 12000 - (end_ms - start_ms)) as need from fx_clips), g as (select c.video_id, c.clip, min(s.start_ms) as a, max(s.end_ms) as b from c join fx_segments s on s.video_id = c.video_id and s.start_ms >= c.start_ms - need and s.end_ms <= c.end_ms + need group by all),
k as (select c.video_id, c.clip, least(start_ms, coalesce(a, start_ms)) as s, greatest(end_ms, coalesce(b, end_ms)) as e from c left join g using (video_id, clip)), p as (select *, greatest(0, s - greatest(0, 12000 - (e - s)) // 2) as s2 from k)
select video_id, clip, s2::bigint as s, least(e + greatest(0, 12000 - (e - s)) // 2, s2 + 60000)::bigint as e from p""")
def gen_min_duration(fx_clips, fx_segments):
    return min_duration(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), fx_segments, 12_000, 60_000).select("video_id", "clip", "s", "e")


_QUALITY = """select c.video_id, c.clip, greatest(1, least(100, 50 + case when a <= 200 then 10 when prev_final then 10 when prev_end is not null and a - prev_end > 1000 then 5 else 0 end + case when regexp_matches(end_word, '[.?!]$') then 15 when end_word like '%,' then 5 else 0 end + case when z - a between 5000 and 20000 then 25 else -15 end)) as score
from (select video_id, clip, start_ms as a, end_ms - 300 as z, (select arg_max(regexp_matches(w.word, '[.?!]$'), w.idx) from fx_words w where w.video_id = k.video_id and w.start_ms < k.start_ms) as prev_final, (select max(w.end_ms) from fx_words w where w.video_id = k.video_id and w.start_ms < k.start_ms) as prev_end, (select arg_max(w.word, w.idx) from fx_words w where w.video_id = k.video_id and w.end_ms <= k.end_ms - 300) as end_word from fx_clips k) c"""


#: The bin of spans that end nowhere; no time falls into it.
_OPEN = -(2**62)


def clip_quality(clips: DataFrame, words: DataFrame, min_ms: int, max_ms: int, base: Column) -> DataFrame:
    """Add ``quality`` (1 to 100) and ``reasons``: how a clip starts and ends, and whether its duration fits."""
    own, c = clips.columns, F.col
    nth = Window.partitionBy("video_id").orderBy("idx")
    # the last word that starts before the clip's start, and the last that ends by its end: a word is the last for the times up to the next
    # word's, so clips' ends meet words' spans in bins and words stay where they are; a video's last span is open and in a bin of its own
    span = lambda k, start, end: F.struct(F.lit(k).alias("_of"), start.alias("_from"), end.alias("_to"))
    v = words.select("video_id", "idx", "word", "start_ms", "end_ms", F.lead("start_ms").over(nth).alias("_s"), F.lead("end_ms").over(nth).alias("_e"))
    v = v.select(c("video_id").alias("_v"), c("idx").alias("_i"), "word", c("end_ms").alias("_ended"), F.explode(F.array(span(0, c("start_ms") + 1, c("_s")), span(1, c("end_ms"), c("_e") - 1))).alias("x"))
    v = v.select("_v", "_i", "word", "_ended", "x.*").where("_from is not null and (_to is null or _to >= _from)").withColumn("_at", F.explode(F.when(c("_to").isNull(), F.array(F.lit(_OPEN))).otherwise(_dealt(c("_from"), c("_to"), BIN_MS))))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), c(e).alias("t")) for k, e in enumerate(("start_ms", "end_ms"))]))
    l = clips.withColumn("_row", F.monotonically_increasing_id()).select(*own, "_row", ends.alias("y")).select(*own, "_row", "y.*")
    l = l.withColumn("_bin", F.explode(F.array(F.floor(c("t") / BIN_MS), F.lit(_OPEN))))
    meet = (c("video_id") == c("_v")) & (c("side") == c("_of")) & (c("_bin") == c("_at")) & (c("t") >= c("_from")) & (c("_to").isNull() | (c("t") <= c("_to")))
    j = l.hint("shuffle_hash").join(v, meet, "left").groupBy("video_id", "_row")
    latest = lambda k: F.when((c("side") == k) & c("_i").isNotNull(), F.struct("_from", "_i"))
    end = j.agg(*[F.first(k).alias(k) for k in own if k != "video_id"], F.max_by(F.struct("word", c("_ended").alias("end_ms")), latest(0)).alias("prev"), F.max_by("word", latest(1)).alias("last_word")).select(*own, "prev", "last_word")
    a, ms = F.col("start_ms"), F.col("end_ms") - F.col("start_ms")
    rules = [
        (a <= 200, 10, "starts the video", 0), (C.sentence_final(F.col("prev.word")), 10, "starts after a sentence", 0), (a - F.col("prev.end_ms") > 1000, 5, "starts after a pause", 0),
        (C.sentence_final(F.col("last_word")), 15, "ends a sentence", 1), (F.col("last_word").endswith(","), 5, "ends a clause", 1),
        (ms.between(min_ms, max_ms), 25, "fits the duration", 2), (F.lit(True), -15, "outside the duration", 2),
    ]
    points, reasons = F.lit(0), []
    for group in (0, 1, 2):
        got = why = None
        for test, value, text, g in rules:
            if g == group:
                got = F.when(test, value) if got is None else got.when(test, value)
                why = F.when(test, F.lit(text)) if why is None else why.when(test, F.lit(text))
        points = points + F.coalesce(got, F.lit(0))
        reasons.append(why)
    return end.withColumns({"quality": C.clamp(base + points, 1, 100), "reasons": F.array_compact(F.array(*reasons))}).drop("prev", "last_word")


@query("score_clip_quality", _QUALITY)
def score_clip_quality(fx_clips, fx_words):
    c = fx_clips.select("video_id", "clip", "start_ms", (F.col("end_ms") - 300).alias("end_ms"))
    return clip_quality(c, fx_words, 5000, 20_000, F.lit(50)).select("video_id", "clip", F.col("quality").alias("score"))


def quality_gate(df: DataFrame, score: str, order: str, floor: int = 80) -> DataFrame:
    """Rows of at least ``floor``, or the video's only row; where none is left, its best."""
    w = Window.partitionBy("video_id")
    best = F.row_number().over(w.orderBy(F.desc(score), order)) == 1
    d = df.withColumns({"_n": F.count("*").over(w), "_top": F.max(score).over(w), "_best": best})
    return d.where((F.col(score) >= floor) | (F.col("_n") == 1) | ((F.col("_top") < floor) & F.col("_best"))).drop("_n", "_top", "_best")


@query("flt_quality_gate", "select video_id, cand, score from (select *, count(*) over v as n, max(score) over v as top, row_number() over (partition by video_id order by score desc, cand) as k from fx_candidates window v as (partition by video_id)) t where score >= 80 or n = 1 or (top < 80 and k = 1)")
def flt_quality_gate(fx_candidates):
    return quality_gate(fx_candidates, "score", "cand").select("video_id", "cand", "score")


@query("set_union_retry", f"with recursive u as (select video_id, cand, start_ms, end_ms, score, 0 as src from fx_candidates where cand % 2 = 0 union all select video_id, cand, start_ms, end_ms, score - 5, 1 from fx_candidates where cand % 3 = 0), {nms_sql('u', 'score desc, src, cand', _CLASH + ' > 0', 4)} select video_id, kept::int as kept, k.c as cand from r")
def set_union_retry(fx_candidates):
    """First answers and retries with a source tag, then no overlap, best first."""
    a = fx_candidates.where("cand % 2 = 0").withColumn("src", F.lit(0))
    b = fx_candidates.where("cand % 3 = 0").withColumns({"score": F.col("score") - 5, "src": F.lit(1)})
    clash = lambda k, r: (r["start_ms"] < k["end_ms"]) & (r["end_ms"] > k["start_ms"])
    return greedy_keep(a.unionByName(b), ["video_id"], [-F.col("score"), F.col("src"), F.col("cand")], ["cand", "start_ms", "end_ms"], clash, 4).select("video_id", "kept", "cand")


def numbered_tokens(candidates: DataFrame) -> DataFrame:
    """``video_id, cand, topic_id, start_ms, end_ms`` and ``tok``: a candidate's distinct tokens as ``(id, far, hook)``, ids
    numbered within the video from its rarest token on. ``far``: another candidate that shares no time holds it too; ``hook``:
    it is in the first sentence. ``m0, m1`` are 128 parities of how many ids fall on each bit: two candidates' differ in no
    more bits than the candidates in tokens. One shuffle by video; what follows reads numbers, not words."""
    tokens = lambda c: F.array_distinct(C.tokens(c))
    keys = ["video_id", "cand", "topic_id", "start_ms", "end_ms"]
    # a first sentence's tokens are the first of the text's; a number of parts that is asked for isn't merged into fewer, as tokens take more room apart
    d = candidates.select(*keys, tokens("text").alias("_tok"), F.size(tokens(C.first_sentence(F.col("text")))).alias("_n"))
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id")
    t = d.select(*keys, "_n", F.posexplode_outer("_tok").alias("at", "t"))
    w = Window.partitionBy("video_id", "t")
    t = t.withColumns({"df": F.count("*").over(w), "far": (F.min("end_ms").over(w) <= F.col("start_ms")) | (F.max("start_ms").over(w) >= F.col("end_ms"))})
    t = t.withColumn("id", F.when(F.col("t").isNotNull(), F.dense_rank().over(Window.partitionBy("video_id").orderBy("df", "t"))))
    tok = F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("id", "far", (F.col("at") < F.col("_n")).alias("hook")))))
    parity = lambda i: F.bit_xor(F.expr(f"if(id % 128 div 64 = {i}, shiftleft(1L, id % 64), 0L)"))
    return t.groupBy(*keys).agg(tok.alias("tok"), parity(0).alias("m0"), parity(1).alias("m1"))


def alike_pairs(d: DataFrame, tokens: Column, least: tuple[int, int], whole: tuple[int, int], on: list[str]) -> DataFrame:
    """``video_id, a, b`` (a < b) without common time, where ``tokens`` (rarest first) can have a Jaccard of ``least`` (over, under)
    and all tokens one of ``whole``. One of the rarest tokens, as many as can be missing and one more, must be in both;
    what is left behind that token, the sizes and the parities must suffice."""
    (num, den), (w_num, w_den) = least, whole
    t = d.withColumn("_tok", tokens).withColumn("n", F.size("_tok"))
    t = t.select("video_id", "topic_id", "cand", "start_ms", "end_ms", "m0", "m1", F.size("tok").alias("size"), "n", F.posexplode(F.slice("_tok", 1, F.floor(F.col("n") * (den - num) / den).cast("int") + 1)).alias("at", "_x"))
    t = t.where("_x.far").select("video_id", "topic_id", "cand", "start_ms", "end_ms", "m0", "m1", "size", (F.col("n") - F.col("at")).alias("left"), "n", F.col("_x.id").alias("id"))
    a, b = (t.select(*[F.col(c) if c in on else F.col(c).alias(p + c) for c in t.columns if c in on or c != "topic_id"]) for p in ("a_", "b_"))
    c = F.col
    differ = F.bit_count(c("a_m0").bitwiseXOR(c("b_m0"))) + F.bit_count(c("a_m1").bitwiseXOR(c("b_m1")))
    may = (F.least("a_left", "b_left") * (num + den) >= (c("a_n") + c("b_n")) * num) & (F.least("a_size", "b_size") * w_den >= F.greatest("a_size", "b_size") * w_num)
    may &= differ * (w_num + w_den) <= (c("a_size") + c("b_size")) * (w_den - w_num)
    apart = (c("a_end_ms") <= c("b_start_ms")) | (c("b_end_ms") <= c("a_start_ms"))
    return a.join(b, on).where((c("a_cand") < c("b_cand")) & apart & may).select("video_id", c("a_cand").alias("a"), c("b_cand").alias("b"))


def pairs_to_compare(d: DataFrame) -> DataFrame:
    """``video_id, a, b`` (a < b) of candidates (``numbered_tokens``) that can be duplicates: those that share time, and without
    common time those with a Jaccard of their vocabulary of 0.65 that may be, or of one topic with one of their hooks of 0.6
    (under 0.65, the composite needs the topic and that much of the hooks, and half of the vocabulary)."""
    left = d.select("video_id", F.col("cand").alias("a"), "start_ms", "end_ms")
    time = interval_join(left, as_right(d, b="cand")).where("a < b").select("video_id", "a", "b")
    words = alike_pairs(d, F.col("tok"), (13, 20), (13, 20), ["video_id", "id"])
    hooks = alike_pairs(d, F.filter("tok", lambda x: x["hook"]), (3, 5), (1, 2), ["video_id", "topic_id", "id"])
    return time.unionByName(words).unionByName(hooks).distinct()


def duplicate_pairs(candidates: DataFrame) -> DataFrame:
    """``video_id, a, b, similarity, duplicate, reason`` for pairs of a video's candidates (a < b) that are duplicates by time,
    vocabulary or all signs together; pairs that can't be are never made (``pairs_to_compare``)."""
    d = materialise(numbered_tokens(candidates), "candidate-tokens")
    ids = d.select("video_id", "cand", "topic_id", "start_ms", "end_ms", F.col("tok.id").alias("tok"), F.transform(F.filter("tok", lambda x: x["hook"]), lambda x: x["id"]).alias("hook"))
    side = lambda p: ids.select("video_id", *[F.col(c).alias(p + c) for c in ids.columns if c != "video_id"], F.col("cand").alias(p[0]))
    j = pairs_to_compare(d).join(side("a_"), ["video_id", "a"]).join(side("b_"), ["video_id", "b"])
    iou = C.iou_union(*[F.col(c) for c in ("a_start_ms", "a_end_ms", "b_start_ms", "b_end_ms")])

    def jaccard(x, y):  # ids are distinct: sizes and what is common give the union
        return C.bound(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(n / (F.size(x) + F.size(y) - n)))

    def judged(s):
        comp = s["jac"] * 0.40 + s["iou"] * 0.30 + s["top"] * 0.15 + s["hk"] * 0.15
        dup = [(s["iou"] >= 0.70, s["iou"], "time"), (s["jac"] >= 0.65, s["jac"], "vocabulary"), (comp >= 0.50, comp, "composite")]
        sim = why = None
        for test, value, name in dup:
            sim = F.when(test, value) if sim is None else sim.when(test, value)
            why = F.when(test, name) if why is None else why.when(test, name)
        return F.struct(sim.alias("similarity"), why.alias("reason"))

    # bound: a filter on columns would have the sets compared again for each mention
    signs = F.struct(jaccard(F.col("a_tok"), F.col("b_tok")).alias("jac"), iou.alias("iou"), (F.col("a_topic_id") == F.col("b_topic_id")).cast("double").alias("top"), jaccard(F.col("a_hook"), F.col("b_hook")).alias("hk"))
    j = j.select("video_id", "a", "b", C.bound(signs, judged).alias("j")).where("j.reason is not null")
    return j.select("video_id", "a", "b", "j.similarity", F.lit(True).alias("duplicate"), "j.reason")


_PAIRS = """d as (select video_id, cand, topic_id, start_ms, end_ms, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) as tok, list_distinct(regexp_extract_all(lower(regexp_extract(text, '^[^.?!]*[.?!]?')), '[a-z0-9'']+')) as hk from fx_candidates),
q as (select a.video_id, a.cand as a, b.cand as b, case when len(list_distinct(list_concat(a.tok, b.tok))) = 0 then 0.0 else len(list_intersect(a.tok, b.tok)) / len(list_distinct(list_concat(a.tok, b.tok))) end as jac, case when len(list_distinct(list_concat(a.hk, b.hk))) = 0 then 0.0 else len(list_intersect(a.hk, b.hk)) / len(list_distinct(list_concat(a.hk, b.hk))) end as hook,
  case when a.topic_id = b.topic_id then 1.0 else 0.0 end as top, greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) as cut, (a.end_ms - a.start_ms) + (b.end_ms - b.start_ms) as len2 from d a join d b on a.video_id = b.video_id and a.cand < b.cand),
s as (select *, cut / greatest(100, len2 - cut) as iou, jac * 0.40 + cut / greatest(100, len2 - cut) * 0.30 + top * 0.15 + hook * 0.15 as comp from q),
pairs as (select video_id, a, b, case when iou >= 0.7 then iou when jac >= 0.65 then jac else comp end as similarity, iou >= 0.7 or jac >= 0.65 or comp >= 0.5 as duplicate, case when iou >= 0.7 then 'time' when jac >= 0.65 then 'vocabulary' when comp >= 0.5 then 'composite' end as reason from s)"""


@query("score_duplicate_pair", f"with {_PAIRS} select * from pairs where duplicate")
def score_duplicate_pair(fx_candidates):
    return duplicate_pairs(fx_candidates)


@query("join_pairwise_theta", "select a.video_id, a.cand as a, b.cand as b from fx_candidates a join fx_candidates b on a.video_id = b.video_id and a.cand < b.cand and a.end_ms > b.start_ms and a.start_ms < b.end_ms")
def join_pairwise_theta(fx_candidates):
    """Pairs of a video's candidates that share time, blocked by bins instead of all pairs."""
    a = fx_candidates.select("video_id", F.col("cand").alias("a"), "start_ms", "end_ms")
    return interval_join(a, as_right(fx_candidates, b="cand")).where("a < b").select("video_id", "a", "b")


_COMP = f"{_PAIRS}, e as (select video_id, a, b from pairs where duplicate union select video_id, b, a from pairs where duplicate), reach as (select distinct video_id, a as node, a as other from e union select r.video_id, r.node, e.b from reach r join e on e.video_id = r.video_id and e.a = r.other), comp as (select video_id, node, min(other) as component from reach group by all)"


#: What tells whether candidates are duplicates.
_LINKS = ["video_id", "cand", "topic_id", "start_ms", "end_ms", "text"]


def linked(candidates: DataFrame) -> DataFrame:
    """Candidates, without their text, and ``component``: the smallest candidate of their video that duplicates link them to, null for those
    without a duplicate. A video is looked at in the task that reads it; only those too large for that have their pairs joined and their
    components found in rounds."""
    own = [c for c in candidates.columns if c != "text"]
    d = linked_in_tasks(candidates)
    late = d.where("late").drop("component", "late")
    d = d.where("not late").select(*own, "component")
    if late.isEmpty():
        return d
    pairs = duplicate_pairs(late)
    node = lambda c: F.format_string("%d.%019d", "video_id", c)
    comp = connected_components(pairs.select(node("a").alias("src"), node("b").alias("dst")))
    part = lambda c, i: F.split(c, "[.]")[i].cast("long")
    comp = comp.select(part("node", 0).alias("video_id"), part("node", 1).alias("cand"), part("component", 1).alias("component"))
    return d.unionByName(late.select(own).join(comp, ["video_id", "cand"], "left"))


def components_of(candidates: DataFrame) -> DataFrame:
    d = linked(candidates.select(*_LINKS)).where("component is not null")
    return d.select(F.col("video_id").cast("long").alias("video_id"), F.col("cand").cast("long").alias("node"), "component").distinct()


@query("graph_components", f"with recursive {_COMP} select * from comp")
def graph_components(fx_candidates):
    return components_of(fx_candidates)


_DEDUPE = f"{_COMP}, m as (select c.video_id, c.cand, c.score, coalesce(component, c.cand) as cluster, count(*) over (partition by c.video_id, coalesce(component, c.cand)) as n, row_number() over (partition by c.video_id, coalesce(component, c.cand) order by c.score desc, c.cand) as k from fx_candidates c left join comp on comp.video_id = c.video_id and comp.node = c.cand)"


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Each candidate, without its text, with its cluster and status: the cluster's best by score is retained, the rest rejected."""
    c = linked(candidates).withColumn("cluster", F.coalesce("component", "cand"))
    w = Window.partitionBy("video_id", "cluster")
    k = F.row_number().over(w.orderBy(F.desc("score"), "cand"))
    return c.withColumns({"n": F.count("*").over(w), "k": k}).withColumn("status", F.when(F.col("n") == 1, "UNIQUE").when(F.col("k") == 1, "RETAINED").otherwise("REJECTED_DUPLICATE")).drop("component", "k")


@query("graph_dedupe", f"with recursive {_DEDUPE} select video_id, cand, cluster, case when n = 1 then 'UNIQUE' when k = 1 then 'RETAINED' else 'REJECTED_DUPLICATE' end as status from m")
def graph_dedupe(fx_candidates):
    return dedupe_candidates(fx_candidates.select(*_LINKS, "score")).select("video_id", "cand", "cluster", "status")


@query("agg_cluster_summary", f"with recursive {_DEDUPE} select video_id, cluster, arg_max(cand, -k) as retained, string_agg(case when k > 1 then cand::varchar end, ',' order by cand) as rejected, count(*) as members from m where n > 1 group by all")
def agg_cluster_summary(fx_candidates):
    d = dedupe_candidates(fx_candidates.select(*_LINKS, "score")).where("n > 1")
    lost = F.sort_array(F.collect_list(F.when(F.col("status") == "REJECTED_DUPLICATE", F.col("cand"))))
    return d.groupBy("video_id", "cluster").agg(F.max(F.when(F.col("status") == "RETAINED", F.col("cand"))).alias("retained"), F.array_join(F.transform(lost, lambda x: x.cast("string")), ",").alias("rejected"), F.count("*").alias("members"))


@query("join_anti_duplicates", "select video_id, cand from (select *, bool_or(score >= 60) over (partition by video_id) as any_ok from fx_candidates) t where score >= 60 or not any_ok")
def join_anti_duplicates(fx_candidates):
    """Rows that aren't rejected; all of a video where none is left."""
    ok = F.col("score") >= 60
    return fx_candidates.withColumn("any_ok", F.bool_or(ok).over(Window.partitionBy("video_id"))).where(ok | ~F.col("any_ok")).select("video_id", "cand")


WEIGHTS = {"score": 0.5, "retention": 0.3, "standalone": 0.1, "boundary": 0.1}


def ranking_score(weights: dict[str, float] = WEIGHTS) -> tuple[Column, Column]:
    """Score and breakdown: signals of 0..1 by normalised weights (ten-thousandths), each contribution rounded half up."""
    total = sum(weights.values())
    raw = {"score": F.col("score") / 100.0, "retention": F.col("retention") / 100.0, "standalone": F.col("standalone") / 5.0, "boundary": F.col("boundary") / 100.0}
    parts = {k: F.floor(raw[k] * (round(w / total, 4)) * 10000 + 0.5) for k, w in weights.items()}
    breakdown = F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*[F.struct(raw[k].alias("raw"), F.lit(round(weights[k] / total, 4)).alias("weight"), (v / 10000.0).alias("contribution")) for k, v in parts.items()]))
    whole = None
    for v in parts.values():
        whole = v if whole is None else whole + v
    return C.clamp(whole, 0, 10000) / 10000.0, breakdown


_RANK = "rk as (select *, greatest(0, least(10000, floor(score / 100.0 * 0.5 * 10000 + 0.5) + floor(retention / 100.0 * 0.3 * 10000 + 0.5) + floor(standalone / 5.0 * 0.1 * 10000 + 0.5) + floor(boundary / 100.0 * 0.1 * 10000 + 0.5))) / 10000.0 as ranking from fx_candidates)"


@query("score_ranking", f"with {_RANK} select video_id, cand, ranking from rk")
def score_ranking(fx_candidates):
    return fx_candidates.select("video_id", "cand", ranking_score()[0].alias("ranking"))


@query("udf_ranking_weights", "select video_id, cand, (floor(score / 100.0 * 0.75 * 10000 + 0.5) + floor(retention / 100.0 * 0.25 * 10000 + 0.5)) / 10000.0 as ranking from fx_candidates")
def udf_ranking_weights(fx_candidates):
    """A caller's weights, normalised."""
    return fx_candidates.select("video_id", "cand", ranking_score({"score": 3.0, "retention": 1.0})[0].alias("ranking"))


def budget_select(ranked: DataFrame, max_clips: int, max_ms: int) -> DataFrame:
    """In rank order: up to ``max_clips`` within ``max_ms`` in all (the first always fits); with over twice as many
    candidates as clips, none of the last selected topic. Adds ``selected`` and ``reason``."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "cand", "topic_id", (F.col("end_ms") - F.col("start_ms")).cast("long").alias("ms"))))
    kind = "struct<n:int,used:bigint,topic:string,out:array<struct<cand:bigint,rank:int,reason:string>>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.lit("").alias("topic"), F.array().cast("array<struct<cand:bigint,rank:int,reason:string>>").alias("out")).cast(kind)

    def fold(size: Column) -> Callable[[Column, Column], Column]:
        def step(s, r):
            why = F.when(s["n"] >= max_clips, "count").when((s["used"] + r["ms"] > max_ms) & (s["n"] > 0), "duration").when((r["topic_id"] == s["topic"]) & (size > 2 * max_clips), "topic").otherwise("selected")
            take = why == "selected"
            out = F.array_append(s["out"], F.struct(r["cand"].cast("long").alias("cand"), r["rank"].cast("int").alias("rank"), why.alias("reason")))
            return F.struct((s["n"] + F.when(take, 1).otherwise(0)).alias("n"), (s["used"] + F.when(take, r["ms"]).otherwise(0)).alias("used"), F.when(take, r["topic_id"]).otherwise(s["topic"]).alias("topic"), out.alias("out")).cast(kind)

        return step

    g = ranked.groupBy("video_id").agg(rows.alias("r"))
    g = g.withColumn("o", F.aggregate("r", start, fold(F.size("r")), lambda s: s["out"]))
    return g.select("video_id", F.explode("o").alias("x")).select("video_id", "x.cand", "x.rank", (F.col("x.reason") == "selected").alias("selected"), "x.reason")


@query("win_budget_select", f"""with recursive {_RANK}, o as (select *, end_ms - start_ms as ms, row_number() over (partition by video_id order by ranking desc, cand) as n, count(*) over (partition by video_id) as size from rk),
g as (select video_id, 0::bigint as n, 0::bigint as cand, 0 as sel, 0::bigint as used, '' as topic, '' as reason from (select distinct video_id from o) x
 union all select g.video_id, o.n, o.cand, g.sel + (y.why = 'selected')::int, g.used + case when y.why = 'selected' then o.ms else 0 end::bigint, case when y.why = 'selected' then o.topic_id else g.topic end, y.why from g join o on o.video_id = g.video_id and o.n = g.n + 1,
 lateral (select case when g.sel >= 3 then 'count' when g.used + o.ms > 90000 and g.sel > 0 then 'duration' when o.topic_id = g.topic and o.size > 6 then 'topic' else 'selected' end as why) y)
select video_id, cand, n::int as rank, reason = 'selected' as selected, reason from g where n > 0""")
def win_budget_select(fx_candidates):
    r = fx_candidates.withColumn("ranking", ranking_score()[0])
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("ranking"), "cand")))
    return budget_select(r, 3, 90_000)


def rule_pipeline(segments: DataFrame, words: DataFrame, speech: DataFrame, scenes: DataFrame, clips: int = 5, min_ms: int = 20_000, max_ms: int = 60_000) -> DataFrame:
    """Highlights of each video from its transcript: windows, scores, suppression, snapping to speech, sentences and scenes,
    minimum duration, quality gate, merging of overlaps, numbered by start."""
    best = greedy_keep(scored_windows(segments, min_ms, max_ms).withColumn("cand", F.col("first_seg") * 100000 + F.col("last_seg")), ["video_id"], [-F.col("score"), F.col("cand")], ["cand", "start_ms", "end_ms", "score"], overlap_share(0.35), clips)
    keep = ["video_id", "cand", "score"]
    move = lambda d: d.select(*keep, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    # a handful of rows per video: written, so that steps which use them twice don't choose them again
    c = materialise(best.select(*keep, "start_ms", "end_ms"), "chosen")
    c = materialise(move(snap_speech(c, speech, max_ms)), "snapped")
    c = move(sentence_snap(c, words))
    c = move(snap_scene(c, scenes, max_ms))
    c = move(min_duration(materialise(c, "snapped"), segments, min_ms, max_ms))
    q = clip_quality(c, words, min_ms, max_ms, F.floor(F.col("score")).cast("int"))
    q = quality_gate(q, "quality", "cand")
    m = merge_overlaps_of(q.select("video_id", "cand", "start_ms", "end_ms", F.col("quality").alias("score")), max_ms)
    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "cand"))
    return m.select("video_id", F.format_string("clip_%02d", nth).alias("id"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "score", F.col("n").alias("merged"))


def _pipeline_sql(clips: int = 5) -> str:
    """The rule pipeline step by step; the greedy choice as repeated best of what is left."""
    from timeloom.operators.windows import _BOUNDS

    parts = [_WIN, "l0 as (select video_id, first_seg * 100000 + last_seg as cand, start_ms, end_ms, score from sc)"]
    for i in range(clips):
        parts.append(f"k{i} as (select video_id, cand, start_ms, end_ms, score from (select *, row_number() over (partition by video_id order by score desc, cand) as n from l{i}) t where n = 1)")
        parts.append(f"l{i + 1} as (select l.* from l{i} l join k{i} k using (video_id) where not (l.cand = k.cand or least(k.end_ms, l.end_ms) - greatest(k.start_ms, l.start_ms) > least(k.end_ms - k.start_ms, l.end_ms - l.start_ms) * 0.35))")
    parts += [
        "q1 as (" + " union all ".join(f"select * from k{i}" for i in range(clips)) + ")",
        "h1 as (select c.video_id, c.cand, c.score, c.start_ms, c.end_ms, min(s.start_ms) as a, max(s.end_ms) as b from q1 c join fx_speech s on s.video_id = c.video_id and s.end_ms > c.start_ms and s.start_ms < c.end_ms group by all)",
        "q2 as (select video_id, cand, score, greatest(a, start_ms - 250) as start_ms, least(least(b, end_ms + 250), greatest(a, start_ms - 250) + 60000) as end_ms from h1)",
        _BOUNDS.replace("f as (", "bf as (").replace("from f)", "from bf)").replace("b as (select *, max", "bb as (select *, max"),
        "h2 as (select c.video_id, c.cand, c.score, c.start_ms, c.end_ms, arg_min(w.s, w.idx) as s, arg_max(w.e, w.idx) as e from q2 c join bb w on w.video_id = c.video_id and w.end_ms > c.start_ms and w.start_ms < c.end_ms group by all)",
        "q3 as (select video_id, cand, score, case when start_ms - s <= 15000 then s else start_ms end as start_ms, case when e - end_ms <= 20000 then e else end_ms end as end_ms from h2)",
        "h3 as (select c.video_id, c.cand, c.score, c.start_ms, c.end_ms, min(s.start_ms) as a, max(s.end_ms) as b from q3 c left join fx_scenes s on s.video_id = c.video_id and s.end_ms > c.start_ms and s.start_ms < c.end_ms group by all)",
        "h4 as (select *, case when abs(start_ms - a) <= 1250 then a else start_ms end as s, case when abs(end_ms - b) <= 1250 then b else end_ms end as e from h3)",
        "q4 as (select video_id, cand, score, case when least(e, s + 60000) <= s then start_ms else s end as start_ms, case when least(e, s + 60000) <= s then end_ms else least(e, s + 60000) end as end_ms from h4)",
        "h5 as (select c.video_id, c.cand, min(s.start_ms) as a, max(s.end_ms) as b from q4 c join fx_segments s on s.video_id = c.video_id and s.start_ms >= c.start_ms - greatest(0, 20000 - (c.end_ms - c.start_ms)) and s.end_ms <= c.end_ms + greatest(0, 20000 - (c.end_ms - c.start_ms)) group by all)",
        "h6 as (select c.video_id, c.cand, c.score, least(start_ms, coalesce(a, start_ms)) as s, greatest(end_ms, coalesce(b, end_ms)) as e from q4 c left join h5 using (video_id, cand))",
        "h7 as (select *, greatest(0, 20000 - (e - s)) // 2 as pad from h6)",
        "q5 as (select video_id, cand, score, greatest(0, s - pad) as start_ms, least(e + pad, greatest(0, s - pad) + 60000) as end_ms from h7)",
        "h8 as (select c.video_id, c.cand, arg_max(regexp_matches(w.word, '[.?!]$'), w.idx) as pf, max(w.end_ms) as pe from q5 c join fx_words w on w.video_id = c.video_id and w.start_ms < c.start_ms group by all)",
        "h9 as (select c.video_id, c.cand, arg_max(w.word, w.idx) as lw from q5 c join fx_words w on w.video_id = c.video_id and w.end_ms <= c.end_ms group by all)",
        "q6 as (select c.*, greatest(1, least(100, floor(score)::int + case when start_ms <= 200 then 10 when pf then 10 when pe is not null and start_ms - pe > 1000 then 5 else 0 end + case when regexp_matches(lw, '[.?!]$') then 15 when lw like '%,' then 5 else 0 end + case when end_ms - start_ms between 20000 and 60000 then 25 else -15 end)) as q from q5 c left join h8 using (video_id, cand) left join h9 using (video_id, cand))",
        "q7 as (select * from (select *, count(*) over v as n, max(q) over v as top, row_number() over (partition by video_id order by q desc, cand) as best from q6 window v as (partition by video_id)) t where q >= 80 or n = 1 or (top < 80 and best = 1))",
        "o as (select video_id, cand::bigint as c, start_ms::bigint as s, end_ms::bigint as e, q::double as score, row_number() over (partition by video_id order by start_ms, cand) as n from q7)",
        """g as (select video_id, n, []::struct(s bigint, e bigint, score double, c bigint, n bigint)[] as done, {'s': s, 'e': e, 'score': score, 'c': c, 'n': 1::bigint} as last from o where n = 1
 union all select g.video_id, t.n, case when x.clash then g.done else list_append(g.done, g.last) end,
  case when not x.clash or (not x.fits and t.score > g.last.score) then {'s': t.s, 'e': t.e, 'score': t.score, 'c': t.c, 'n': 1::bigint} when x.fits then {'s': least(g.last.s, t.s), 'e': greatest(g.last.e, t.e), 'score': greatest(g.last.score, t.score), 'c': g.last.c, 'n': g.last.n + 1} else g.last end
  from g join o t on t.video_id = g.video_id and t.n = g.n + 1, lateral (select least(g.last.e, t.e) - greatest(g.last.s, t.s) > least(g.last.e - g.last.s, t.e - t.s) * 0.30 as clash, greatest(g.last.e, t.e) - least(g.last.s, t.s) <= 60000 as fits) x)""",
        "z as (select video_id, unnest(l) as k from (select video_id, list_append(arg_max(done, n), arg_max(last, n)) as l from g group by video_id) x)",
    ]
    return "with recursive " + ",\n".join(parts) + " select video_id, 'clip_' || lpad((row_number() over (partition by video_id order by k.s, k.c))::varchar, 2, '0') as id, k.s as start_ms, k.e as end_ms, k.e - k.s as duration_ms, k.score as score, k.n as merged from z"


@query("gen_rule_pipeline", _pipeline_sql())
def gen_rule_pipeline(fx_segments, fx_words, fx_speech, fx_scenes):
    return rule_pipeline(fx_segments, fx_words, fx_speech, fx_scenes)
