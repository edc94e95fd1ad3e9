"""Row-wise rules: text, durations, detections, settings, names and formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from timeloom.functions import columns as C
from timeloom.plans.catalog import query
from timeloom.plans.scratch import listed, shared_folder


@query("prj_clean_text", "select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) as clean from documents")
def prj_clean_text(documents):
    return documents.select("doc_id", C.clean_text("text").alias("clean"))


@query("prj_duration_band", "select o_orderkey, case o_orderkey % 4 when 0 then 'short' when 1 then 'medium' when 2 then 'long' else 'auto' end as wish, case (o_orderkey % 4) when 0 then 15 when 1 then 30 when 2 then 60 else 20 end as min_s, case (o_orderkey % 4) when 0 then 30 when 1 then 60 when 2 then 90 else 60 end as max_s from orders")
def prj_duration_band(orders):
    """Preferred duration as limits in seconds."""
    k = F.col("o_orderkey") % 4
    pick = lambda a, b, c, d: F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(d)
    return orders.select("o_orderkey", pick("short", "medium", "long", "auto").alias("wish"), pick(15, 30, 60, 20).alias("min_s"), pick(30, 60, 90, 60).alias("max_s"))


@query("prj_clip_budget", "select doc_id, (case when doc_id % 2 = 0 then greatest(1, least(20, doc_id % 30)) else greatest(5, least(15, ceil(n_chars / 180.0))) end)::int as clips from documents")
def prj_clip_budget(documents):
    """By hand: 1 to 20; else one for 180 s, 5 to 15."""
    return documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, C.clamp(F.col("doc_id") % 30, 1, 20)).otherwise(C.clamp(F.ceil(F.col("n_chars") / 180.0), 5, 15)).cast("int").alias("clips"))


@query("flt_person_detection", "select event_id, w * h * conf_pct / 100.0 * (1.0 - abs(x + w / 2.0 - 960.0) / 1920.0) as score from fx_samples where conf_pct >= 40 and w / 1920.0 >= 0.06 and h / 1080.0 >= 0.1")
def flt_person_detection(fx_samples):
    """Confident boxes of some size, scored by area, confidence and closeness to the middle of a 1920x1080 frame."""
    s = fx_samples.where((F.col("conf_pct") >= 40) & (F.col("w") / 1920.0 >= 0.06) & (F.col("h") / 1080.0 >= 0.1))
    return s.select("event_id", (F.col("w") * F.col("h") * F.col("conf_pct") / 100.0 * (1.0 - F.abs(F.col("x") + F.col("w") / 2.0 - 960.0) / 1920.0)).alias("score"))


@query("flt_meaningfully_visible", "select event_id, (w * h / (1920.0 * 1080.0) >= 0.055 and x >= 1920.0 * 0.03 and x + w <= 1920.0 * 0.97) as visible from fx_samples")
def flt_meaningfully_visible(fx_samples):
    return fx_samples.select("event_id", ((F.col("w") * F.col("h") / F.lit(1920.0 * 1080.0) >= 0.055) & (F.col("x") >= F.lit(1920.0 * 0.03)) & (F.col("x") + F.col("w") <= F.lit(1920.0 * 0.97))).alias("visible"))


@query("flt_bad_fragment", "select video_id, seg_idx from fx_segments where word_count < 3 or regexp_matches(lower(text), '^(and|but|so|or|the) ') or regexp_matches(lower(text), ' (and|but|or|the|of|to)[.?!]?$')")
def flt_bad_fragment(fx_segments):
    """Fewer than three words, or starting or ending like a fragment."""
    t = F.lower("text")
    return fx_segments.where((F.col("word_count") < 3) | t.rlike("^(and|but|so|or|the) ") | t.rlike(" (and|but|or|the|of|to)[.?!]?$")).select("video_id", "seg_idx")


@query("flt_log_noise", "select seq, line from fx_lines where not regexp_matches(line, '(\"percent\":[0-9][,}])|(\"stage\":\"(audio|vad)\")')")
def flt_log_noise(fx_lines):
    """Lines without technical noise."""
    return fx_lines.where(~F.col("line").rlike('("percent":[0-9][,}])|("stage":"(audio|vad)")')).select("seq", "line")


@query("flt_valid_timestamps", "select video_id, cand, start_ms, least(end_ms, 60000)::bigint as end_ms from fx_candidates where start_ms >= 0 and start_ms < 60000 and least(end_ms, 60000) > start_ms")
def flt_valid_timestamps(fx_candidates):
    """Starts inside the video (here 60 s), ends clamped to it."""
    e = F.least("end_ms", F.lit(60000))
    return fx_candidates.where((F.col("start_ms") >= 0) & (F.col("start_ms") < 60000) & (e > F.col("start_ms"))).select("video_id", "cand", "start_ms", e.alias("end_ms"))


@query("prj_box_center", "select event_id, x, y, greatest(1, w) as w, greatest(1, h) as h, x + w / 2.0 as cx, y + h / 2.0 as cy, t_ms / 1000.0 as seconds from fx_samples")
def prj_box_center(fx_samples):
    return fx_samples.select("event_id", "x", "y", F.greatest(F.lit(1), "w").alias("w"), F.greatest(F.lit(1), "h").alias("h"), (F.col("x") + F.col("w") / 2.0).alias("cx"), (F.col("y") + F.col("h") / 2.0).alias("cy"), (F.col("t_ms") / 1000.0).alias("seconds"))


@query("prj_body_to_face", "select event_id, x + w * 0.5 as cx, y + h * 0.18 as cy, w * 0.38 as fw, h * 0.22 as fh, conf_pct / 100.0 * 0.75 as conf from fx_samples")
def prj_body_to_face(fx_samples):
    """A face box estimated from a body box, at three quarters of its confidence."""
    c = F.col
    return fx_samples.select("event_id", (c("x") + c("w") * 0.5).alias("cx"), (c("y") + c("h") * 0.18).alias("cy"), (c("w") * 0.38).alias("fw"), (c("h") * 0.22).alias("fh"), (c("conf_pct") / 100.0 * 0.75).alias("conf"))


@query("prj_crop_target", "with z as (select *, case when w < 150 then 1.4 when w < 300 then 1.2 else 1.0 end as zoom from fx_samples), d as (select *, floor(608.0 / zoom) as cw, floor(1080.0 / zoom) as ch from z) select event_id, zoom, greatest(0.0, least(1920.0 - cw, x + w / 2.0 - cw / 2.0)) as left_px, greatest(0.0, least(1080.0 - ch, y + h * 0.2 - ch * 0.35)) as top_px from d")
def prj_crop_target(fx_samples):
    """A portrait window around an anchor with headroom, inside the frame, closer for smaller bodies."""
    c = F.col
    z = fx_samples.withColumn("zoom", F.when(c("w") < 150, 1.4).when(c("w") < 300, 1.2).otherwise(1.0))
    d = z.withColumns({"cw": F.floor(F.lit(608.0) / c("zoom")), "ch": F.floor(F.lit(1080.0) / c("zoom"))})
    return d.select("event_id", "zoom", F.greatest(F.lit(0.0), F.least(F.lit(1920.0) - c("cw"), c("x") + c("w") / 2.0 - c("cw") / 2.0)).alias("left_px"), F.greatest(F.lit(0.0), F.least(F.lit(1080.0) - c("ch"), c("y") + c("h") * 0.2 - c("ch") * 0.35)).alias("top_px"))


@query("prj_optional_input", "select c.video_id, count(t.video_id) as turns from (select distinct video_id from fx_turns) c left join (select * from fx_turns where video_id % 3 <> 0) t using (video_id) group by all")
def prj_optional_input(fx_turns):
    """A video whose artifact is marked as skipped counts as having none."""
    skipped = fx_turns.withColumn("skipped", F.col("video_id") % 3 == 0)
    return fx_turns.select("video_id").distinct().join(skipped.where("not skipped").groupBy("video_id").agg(F.count("*").alias("n")), "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("turns"))


@query("prj_aspect_dims", "select p_partkey, case p_size % 4 when 0 then 1080 when 1 then 1920 when 2 then 1080 else 1080 end as width, case p_size % 4 when 0 then 1920 when 1 then 1080 when 2 then 1080 else 1350 end as height from part")
def prj_aspect_dims(part):
    """9:16, 16:9, 1:1 and 4:5 as pixels."""
    aspect = F.element_at(F.array(*map(F.lit, ("9:16", "16:9", "1:1", "4:5"))), (F.col("p_size") % 4 + 1).cast("int"))
    return part.select("p_partkey", F.when(aspect == "16:9", 1920).otherwise(1080).alias("width"), F.when(aspect == "9:16", 1920).when(aspect == "4:5", 1350).otherwise(1080).alias("height"))


@query("prj_normalize_score", "select event_id, (case when value is null then null when value > 0 and value <= 1 then greatest(0, least(100, floor(value * 100 + 0.5))) else greatest(0, least(100, floor(value + 0.5))) end)::bigint as score from events")
def prj_normalize_score(events):
    """Shares of (0, 1] as percent, rounded half up, 0 to 100; null and NaN stay null."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return events.select("event_id", F.when(v.isNotNull(), C.clamp(F.floor(F.when((v > 0) & (v <= 1), v * 100).otherwise(v) + 0.5), 0, 100)).alias("score"))


@query("prj_hook_precedence", "select p_partkey, coalesce(nullif(trim(case when p_partkey % 3 = 0 then p_name else ' ' end), ''), nullif(trim(case when p_partkey % 2 = 0 then p_brand end), ''), nullif(trim(p_type), '')) as hook from part")
def prj_hook_precedence(part):
    """User's hook, else the canonical, else the clip's; blank counts as missing."""
    k = F.col("p_partkey")
    options = [F.when(k % 3 == 0, F.col("p_name")).otherwise(" "), F.when(k % 2 == 0, F.col("p_brand")), F.col("p_type")]
    return part.select("p_partkey", F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options]).alias("hook"))


@query("prj_flag_precedence", "select p_partkey, coalesce(case when p_partkey % 5 = 0 then false end, case when p_partkey % 3 = 0 then p_size > 20 end, true) as enabled from part")
def prj_flag_precedence(part):
    """The first flag present, else true."""
    flags = F.map_filter(F.create_map(F.lit("user"), F.when(F.col("p_partkey") % 5 == 0, False), F.lit("saved"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") > 20)), lambda _, v: v.isNotNull())
    return part.select("p_partkey", F.coalesce(flags["user"], flags["saved"], F.lit(True)).alias("enabled"))


@query("prj_setting_lookup", "select p_partkey, coalesce(case when p_partkey % 4 = 0 then p_brand end, case when p_partkey % 4 = 1 then p_type end, 'default') as style from part")
def prj_setting_lookup(part):
    """The first of several spellings of a key that is there."""
    m = F.when(F.col("p_partkey") % 4 == 0, F.create_map(F.lit("hookStyle"), F.col("p_brand"))).when(F.col("p_partkey") % 4 == 1, F.create_map(F.lit("hook_style"), F.col("p_type"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return part.select("p_partkey", F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in ("hookStyle", "hook_style", "HookStyle", "hookstyle")], F.lit("default")).alias("style"))


@query("prj_settings_migrate", "select p_partkey, case when p_partkey % 2 = 0 then p_size::varchar else (case when p_partkey % 3 = 0 then p_brand else '5' end) end as clip_count, case when p_partkey % 2 = 1 and p_partkey % 3 = 0 then 'new' else 'default' end as origin from part")
def prj_settings_migrate(part):
    """Old keys renamed unless the new one exists, ``hook1`` keys dropped, defaults beneath."""
    k = F.col("p_partkey")
    old = F.when(k % 2 == 0, F.create_map(F.lit("maxClips"), F.col("p_size").cast("string"), F.lit("hook1Text"), F.lit("x"))).when(k % 3 == 0, F.create_map(F.lit("clipCount"), F.col("p_brand"), F.lit("origin"), F.lit("new"))).otherwise(F.create_map(F.lit("hook1Size"), F.lit("3")))
    renamed = F.transform_keys(F.map_filter(old, lambda n, _: ~n.startswith("hook1") & ~((n == "maxClips") & F.map_contains_key(old, "clipCount"))), lambda n, _: F.when(n == "maxClips", "clipCount").otherwise(n))
    get = lambda name, default: F.coalesce(F.try_element_at(renamed, F.lit(name)), F.lit(default))  # noqa: E731  the overlay, key by key
    return part.select("p_partkey", get("clipCount", "5").alias("clip_count"), get("origin", "default").alias("origin"))


@query("prj_config_overlay", "select n_nationkey, case when n_regionkey = 1 then n_name else 'base' end as model, case when n_regionkey = 2 then '9' else '3' end as size, 'cpu' as device from nation")
def prj_config_overlay(nation):
    """A two-level overlay: each section's own keys win, others stay."""
    base = {"model": "base", "size": "3", "device": "cpu"}
    own = F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("model"), F.col("n_name"))).when(F.col("n_regionkey") == 2, F.create_map(F.lit("size"), F.lit("9")))
    return nation.select("n_nationkey", *[F.coalesce(F.try_element_at(own, F.lit(k)), F.lit(v)).alias(k) for k, v in base.items()])


@query("prj_settings_source", "select c_custkey, coalesce(a.clerk, b.clerk, 'none') as settings from customer left join (select o_custkey, min(o_orderpriority) as clerk from orders where o_orderstatus = 'F' group by 1) a on a.o_custkey = c_custkey left join (select o_custkey, min(o_orderpriority) as clerk from orders where o_orderstatus <> 'F' group by 1) b on b.o_custkey = c_custkey")
def prj_settings_source(customer, orders):
    """The first of several settings documents that exists."""
    best = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderpriority", F.struct((F.col("o_orderstatus") != "F").cast("int"), "o_orderpriority")).alias("s"))
    return customer.select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit("none")).alias("settings"))


@query("prj_project_name", "select page_id, trim(regexp_replace(regexp_replace(split_part(url, '/', -1), '[.][a-z0-9]+$', ''), '[-_?=&]+', ' ', 'g')) as name from pages")
def prj_project_name(pages):
    """File name to title: no extension, separators as blanks."""
    return pages.select("page_id", F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split("url", "/"), -1), "[.][a-z0-9]+$", ""), "[-_?=&]+", " ")).alias("name"))


@query("prj_sample_grid", "select video_id, clip, unnest(range(start_ms::bigint, end_ms::bigint + 1, 500))::bigint as t_ms from fx_clips where clip = 1")
def prj_sample_grid(fx_clips):
    return fx_clips.where("clip = 1").select("video_id", "clip", F.explode(F.sequence("start_ms", "end_ms", F.lit(500).cast("long"))).alias("t_ms"))


@query("prj_frame_sampling", "select event_id from fx_samples where (t_ms / 500)::bigint % 3 = 0")
def prj_frame_sampling(fx_samples):
    """Every third frame."""
    return fx_samples.where((F.col("t_ms") / 500).cast("long") % 3 == 0).select("event_id")


@query("flt_valid_assets", "select path, length, case when contains(path, 'en_') then 'english' when contains(path, 'de_') then 'german' else 'general' end as category from fx_assets where path like '%.mp3' and length >= 1000")
def flt_valid_assets(fx_assets):
    """Assets with a sound probe: long enough, with a category by name."""
    return fx_assets.where(F.col("path").endswith(".mp3") & (F.col("length") >= 1000)).select("path", "length", F.when(F.col("path").contains("en_"), "english").when(F.col("path").contains("de_"), "german").otherwise("general").alias("category"))


STREAMS = "array<struct<codec_type:string,codec_name:string,width:int,avg_frame_rate:string>>"


@query("flt_has_audio", "select video_id, json like '%\"codec_type\":\"audio\"%' as has_audio from fx_probe")
def flt_has_audio(fx_probe):
    j = F.from_json("json", f"streams {STREAMS}")
    return fx_probe.select("video_id", F.exists(j["streams"], lambda s: s["codec_type"] == "audio").alias("has_audio"))


@query("src_media_probe", "select video_id, (json_extract_string(v, '$.width'))::int as width, case when json_extract_string(v, '$.avg_frame_rate') = '0/0' then 0.0 else split_part(json_extract_string(v, '$.avg_frame_rate'), '/', 1)::double / split_part(json_extract_string(v, '$.avg_frame_rate'), '/', 2)::double end as fps, a as audio_codec from (select video_id, list_filter(json_extract(json, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'video')[1] as v, json_extract_string(list_filter(json_extract(json, '$.streams[*]'), lambda s: json_extract_string(s, '$.codec_type') = 'audio')[1], '$.codec_name') as a from fx_probe) t")
def src_media_probe(fx_probe):
    """First video and audio stream; frames a second from ``a/b``, 0 where b is 0."""
    s = F.from_json("json", f"streams {STREAMS}")["streams"]
    first = lambda kind: F.try_element_at(F.filter(s, lambda x: x["codec_type"] == kind), F.lit(1))
    rate = F.split(first("video")["avg_frame_rate"], "/")
    fps = F.coalesce(F.try_divide(rate[0].cast("double"), rate[1].cast("double")), F.lit(0.0))
    return fx_probe.select("video_id", first("video")["width"].alias("width"), fps.alias("fps"), first("audio")["codec_name"].alias("audio_codec"))


REPLY = "start long, end long, score string"


def parse_reply(raw):
    """The JSON object inside a loose model reply: what stands between the first ``{`` and the last ``}``; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")), REPLY)


@query("src_llm_json", r"select video_id, cand, json_extract(j, '$.start')::bigint as start_ms, json_extract(j, '$.end')::bigint as end_ms, json_extract_string(j, '$.score') as score from (select *, nullif(regexp_extract(raw, '(?s)(\{.*\})', 1), '')::json as j from fx_replies) t")
def src_llm_json(fx_replies):
    return fx_replies.withColumn("j", parse_reply(F.col("raw"))).select("video_id", "cand", F.col("j.start").alias("start_ms"), F.col("j.end").alias("end_ms"), F.col("j.score").alias("score"))


@query("prj_validate_highlight", r"select video_id, cand, greatest(1, least(100, coalesce(try_cast(json_extract_string(j, '$.score') as int), 70))) as score, 'story_hook' as type from (select *, nullif(regexp_extract(raw, '(?s)(\{.*\})', 1), '')::json as j from fx_replies) t where j is not null")
def prj_validate_highlight(fx_replies):
    """Scores clamped to 1..100 with a default, the type a known one or the default."""
    d = fx_replies.withColumn("j", parse_reply(F.col("raw"))).where("j is not null")
    kind = F.lit(None).cast("string")
    return d.select("video_id", "cand", C.clamp(F.coalesce(F.expr("try_cast(j.score as int)"), F.lit(70)), 1, 100).alias("score"), F.when(kind.isin("funny", "insight"), kind).otherwise("story_hook").alias("type"))


@query("src_word_cleanup", "select video_id, idx, word, coalesce(case when idx % 5 <> 0 then prob_pct end, case when idx % 10 = 0 then 1 end, 0)::int as prob from fx_words where idx % 17 <> 0 and idx % 19 <> 0")
def src_word_cleanup(fx_words):
    """Words without text or times dropped; probability from either spelling, else 0."""
    w = fx_words.select("video_id", "idx", F.when(F.col("idx") % 17 != 0, F.col("word")).alias("word"), F.when(F.col("idx") % 19 != 0, F.col("start_ms")).alias("start"), F.when(F.col("idx") % 5 != 0, F.col("prob_pct")).alias("probability"), F.when(F.col("idx") % 10 == 0, 1).alias("prob"))
    return w.where("word is not null and start is not null").select("video_id", "idx", "word", F.coalesce("probability", "prob", F.lit(0)).cast("int").alias("prob"))


def aliased(raw: Column, kind: str, *paths: str, default: Column | None = None) -> Column:
    """The first of ``paths`` (as ``$.clip.startTime``) at which a JSON text of any shape holds a value of ``kind``, else the default.

    The text is parsed as a variant, so artifacts whose keys, depth and types drift need no common schema; a value that can't
    be cast, a missing path and a text that isn't JSON count as absent, and null texts too."""
    doc = F.try_parse_json(raw)
    found = [F.try_variant_get(doc, p, kind) for p in paths]
    return F.coalesce(*found, *([] if default is None else [default.cast(kind)]))


_ARTIFACT = """case cand % 4 when 0 then '{"startTime":' || cast(start_ms as string) || ',"qualityScore":' || cast(score as string) || '}' when 1 then '{"start_time":"' || cast(start_ms as string) || '","quality_score":"n/a"}'
 when 2 then '{"clip":{"timing":{"startTime":' || cast(start_ms as string) || '},"scores":[{"quality":"' || cast(score as string) || '"}]}}' else '{"start_time":' || cast(start_ms as string) end"""
_STARTS, _QUALITIES = ("$.startTime", "$.start_time", "$.clip.timing.startTime"), ("$.qualityScore", "$.quality_score", "$.clip.scores[0].quality")


def _first_of(paths: tuple[str, ...]) -> str:
    return ", ".join(f"try_cast(json_extract_string(j, '{p}') as bigint)" for p in paths)


@query("src_alias_reader", f"select video_id, cand, coalesce({_first_of(_STARTS)}) as start_time, coalesce({_first_of(_QUALITIES)}, 50) as quality from (select *, try_cast({_ARTIFACT} as json) as j from fx_candidates) t")
def src_alias_reader(fx_candidates):
    """JSON artifacts with camel or snake keys, nested ones, numbers as texts, broken ones, and defaults."""
    raw = F.expr(_ARTIFACT)
    return fx_candidates.select("video_id", "cand", aliased(raw, "bigint", *_STARTS).alias("start_time"), aliased(raw, "bigint", *_QUALITIES, default=F.lit(50)).alias("quality"))


@query("src_event_log", "select seq, case when line like '{%' then json_extract_string(line, '$.status') else 'log' end as status, case when line like '{%' then (json_extract(line, '$.percent'))::int end as percent, case when line like '{%' then null else line end as plain from fx_lines")
def src_event_log(fx_lines):
    """JSON lines; any other line is a plain log line."""
    j = F.when(F.col("line").startswith("{"), F.from_json("line", "type string, jobId string, stage string, status string, percent int"))
    return fx_lines.withColumn("j", j).select("seq", F.coalesce("j.status", F.lit("log")).alias("status"), F.col("j.percent").alias("percent"), F.when(F.col("j").isNull(), F.col("line")).alias("plain"))


@query("src_transcript", "select video_id, seg_idx, unnest(w) as word, unnest(range(len(w)))::int as pos from (select video_id, seg_idx, string_split(text, ' ') as w from fx_segments) t")
def src_transcript(fx_segments):
    """Segments with nested words, flattened."""
    nested = fx_segments.select("video_id", "seg_idx", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"))).alias("words"))
    return nested.select("video_id", "seg_idx", F.posexplode("words").alias("pos", "w")).select("video_id", "seg_idx", "w.word", "pos")


@query("src_asset_listing", "select project, regexp_extract(path, '[.]([a-z0-9]+)$', 1) as ext, (sum(strlen(path)) + count(*))::bigint as length from fx_assets where path like '%.mp3' or path like '%.mp4' group by all")
def src_asset_listing(fx_assets):
    """Files of the wanted kinds with their size, listed in a shared folder to which each project's lists of assets were written."""
    ext = F.regexp_extract("path", "[.]([a-z0-9]+)$", 1)
    lists = fx_assets.select("project", "path", F.concat(F.lit("p"), "project", F.lit("_"), ext).alias("list")).repartition("list").select(F.col("path").alias("value"), "list")
    folder = f"{shared_folder(lists.sparkSession)}/{lists.sparkSession.sparkContext.applicationId}/assets-{uuid.uuid4().hex}"
    lists.write.partitionBy("list").text(folder)
    found = listed(lists.sparkSession, folder, "*.txt").select(F.regexp_extract("path", "list=p([0-9]+)_([a-z0-9]+)/", 1).cast("long").alias("project"), F.regexp_extract("path", "list=p([0-9]+)_([a-z0-9]+)/", 2).alias("ext"), "length")
    return found.where("ext in ('mp3', 'mp4')").groupBy("project", "ext").agg(F.sum("length").alias("length"))


@query("src_ingest_cache", """with u as (select page_id, case when url like '%watch?v=%' then regexp_extract(url, 'v=([0-9a-f]{11})', 1) when url like '%short.example/%' then regexp_extract(url, 'short.example/([0-9a-f]{11})', 1) when url like '%/embed/%' then regexp_extract(url, 'embed/([0-9a-f]{11})', 1) end as media from fx_urls)
select page_id, media, min(page_id) over (partition by media) < page_id as cached from u where media is not null""")
def src_ingest_cache(fx_urls):
    """A media id from each form of address, and whether an earlier row has ingested it."""
    from pyspark.sql import Window

    m = F.coalesce(*[F.nullif(F.regexp_extract("url", p, 1), F.lit("")) for p in (r"watch\?v=([0-9a-f]{11})", "short[.]example/([0-9a-f]{11})", "embed/([0-9a-f]{11})")])
    u = fx_urls.select("page_id", m.alias("media")).where("media is not null")
    return u.withColumn("cached", F.min("page_id").over(Window.partitionBy("media")) < F.col("page_id"))


@query("src_scene_default", "select video_id, 0 as scene_idx, 0 as start_ms, max(end_ms) as end_ms from fx_words w where not exists (select 1 from fx_scenes s where s.video_id = w.video_id) group by video_id union all select * from fx_scenes")
def src_scene_default(fx_words, fx_scenes):
    """One whole-video scene for videos without scenes."""
    whole = fx_words.groupBy("video_id").agg(F.max("end_ms").alias("end_ms")).join(fx_scenes, "video_id", "left_anti")
    return fx_scenes.select("video_id", F.col("scene_idx").cast("long").alias("scene_idx"), "start_ms", "end_ms").unionByName(whole.select("video_id", F.lit(0).cast("long").alias("scene_idx"), F.lit(0).cast("long").alias("start_ms"), "end_ms"))


@query("fn_clock", "select event_id, (t_ms // 3600000)::varchar || ':' || lpad((t_ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((t_ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((t_ms // 10 % 100)::varchar, 2, '0') as clock from (select event_id, t_ms * 137 as t_ms from fx_samples) t")
def fn_clock(fx_samples):
    return fx_samples.select("event_id", C.clock(F.col("t_ms") * 137).alias("clock"))


@query("fn_colour", "select p_partkey, '&H' || lpad(upper(to_hex(p_size)), 2, '0') || substr(c, 5, 2) || substr(c, 3, 2) || substr(c, 1, 2) as colour from (select p_partkey, p_size, upper(left(md5(p_name), 6)) as c from part) t")
def fn_colour(part):
    return part.select("p_partkey", C.bgr(F.concat(F.lit("#"), F.upper(F.substring(F.md5("p_name"), 1, 6))), F.col("p_size")).alias("colour"))


@query("fn_easing", "select event_id, case when t < 0.5 then 4 * t * t * t else 1 - pow(-2 * t + 2, 3.0) / 2 end as cubic, round(-(cos(pi() * t) - 1) / 2, 9) as sine from (select event_id, conf_pct / 100.0 as t from fx_samples) x")
def fn_easing(fx_samples):
    t = F.col("conf_pct") / 100.0
    return fx_samples.select("event_id", C.ease_cubic(t).alias("cubic"), F.round(C.ease_sine(t), 9).alias("sine"))


@query("fn_stable_choice", "select p_partkey, (('0x' || left(md5(p_name), 8))::bigint % 7)::bigint as pick from part")
def fn_stable_choice(part):
    return part.select("p_partkey", C.stable_choice(F.col("p_name"), F.lit(7)).alias("pick"))


@query("fn_error_class", "select seq, case when contains(lower(line), 'failed') then 'stage_failed' when contains(lower(line), 'timeout') then 'timeout' else 'none' end as kind, contains(lower(line), 'timeout') as retryable from fx_lines")
def fn_error_class(fx_lines):
    low = F.lower("line")
    return fx_lines.select("seq", F.when(low.contains("failed"), "stage_failed").when(low.contains("timeout"), "timeout").otherwise("none").alias("kind"), low.contains("timeout").alias("retryable"))


@query("fn_jaccard", "select a.doc_id, (len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(list_concat(a.t, b.t)))))::double as jaccard from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) as t from documents) a join (select doc_id - 1 as doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) as t from documents) b using (doc_id)")
def fn_jaccard(documents):
    d = documents.select("doc_id", F.array_distinct(C.tokens("text")).alias("t"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id").select("doc_id", C.jaccard(F.col("t"), F.col("u")).alias("jaccard"))
