"""Scalar rules as queries: titles, descriptions, transcript lines, vectors, damping, crops, interpolation, dates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from timeloom.functions import columns as C
from timeloom.plans.catalog import query


@query("fn_title", "select video_id, cand, coalesce(list_filter(list_transform(string_split_regex(text, '[.?!]+'), lambda x: trim(x)), lambda x: len(list_filter(string_split(x, ' '), lambda w: w <> '')) >= 4)[1], 'Clip ' || (cand + 1)::varchar) as title from fx_candidates")
def fn_title(fx_candidates):
    """The first sentence of four words or more, else a number."""
    parts = F.transform(F.split("text", "[.?!]+"), lambda x: F.trim(x))
    long = F.filter(parts, lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != "")) >= 4)
    return fx_candidates.select("video_id", "cand", F.coalesce(F.try_element_at(long, F.lit(1)), F.concat(F.lit("Clip "), (F.col("cand") + 1).cast("string"))).alias("title"))


@query("fn_description", "select video_id, cand, left(text, 60) || '...' || chr(10) || 'Topic ' || topic_id || ', ' || ((end_ms - start_ms) // 1000)::varchar || ' s' as description from fx_candidates")
def fn_description(fx_candidates):
    return fx_candidates.select("video_id", "cand", F.concat(F.left("text", F.lit(60)), F.lit("...\nTopic "), "topic_id", F.lit(", "), F.floor((F.col("end_ms") - F.col("start_ms")) / 1000).cast("string"), F.lit(" s")).alias("description"))


@query("fn_transcript_lines", "select video_id, string_agg('[' || (start_ms // 1000)::varchar || '-' || (end_ms // 1000)::varchar || '] ' || text, chr(10) order by seg_idx) as transcript from fx_segments group by all")
def fn_transcript_lines(fx_segments):
    """Segments as lines with their seconds."""
    s = lambda c: F.floor(F.col(c) / 1000).cast("string")
    line = F.concat(F.lit("["), s("start_ms"), F.lit("-"), s("end_ms"), F.lit("] "), "text")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", line.alias("line")))), lambda x: x["line"])
    return fx_segments.groupBy("video_id").agg(F.array_join(lines, "\n").alias("transcript"))


@query("fn_hashtags", "select video_id, cand, '#' || lower(topic_id) || ' #' || case when score >= 50 then 'viral' else 'clips' end || ' #' || case when end_ms - start_ms < 30000 then 'short' else 'long' end as tags from fx_candidates")
def fn_hashtags(fx_candidates):
    return fx_candidates.select("video_id", "cand", F.concat_ws(" ", F.concat(F.lit("#"), F.lower("topic_id")), F.when(F.col("score") >= 50, "#viral").otherwise("#clips"), F.when(F.col("end_ms") - F.col("start_ms") < 30_000, "#short").otherwise("#long")).alias("tags"))


@query("fn_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def fn_cosine(embeddings):
    """Likeness of neighbouring appearance vectors."""
    d = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return d.join(n, "vec_id").select("vec_id", F.round(C.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


@query("fn_damping", "select video_id, track_id, t_ms, case when abs(d) <= 20 then 0.0 else sign(d) * least(60.0, (abs(d) - 20) * 0.5) end as moved from (select *, x - lag(x, 1, x) over (partition by video_id, track_id order by t_ms) as d from fx_samples) t")
def fn_damping(fx_samples):
    """Moves inside a dead zone count nothing, beyond it half, up to a limit."""
    w = Window.partitionBy("video_id", "track_id").orderBy("t_ms")
    d = F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))
    return fx_samples.withColumn("d", d).select("video_id", "track_id", "t_ms", F.when(F.abs("d") <= 20, 0.0).otherwise(F.signum("d") * F.least(F.lit(60.0), (F.abs("d") - 20) * 0.5)).alias("moved"))


@query("fn_even_crop", "select event_id, (w // 2 * 2)::bigint as cw, (h // 2 * 2)::bigint as ch, greatest(0, least(1920 - w // 2 * 2, x)) // 2 * 2 as cx, greatest(0, least(1080 - h // 2 * 2, y)) // 2 * 2 as cy from fx_samples")
def fn_even_crop(fx_samples):
    """A crop box inside the frame with even sides and corner."""
    even = lambda c: F.floor(c / 2) * 2
    b = fx_samples.withColumns({"cw": even(F.col("w")), "ch": even(F.col("h"))})
    return b.select("event_id", "cw", "ch", even(F.greatest(F.lit(0), F.least(1920 - F.col("cw"), F.col("x")))).alias("cx"), even(F.greatest(F.lit(0), F.least(1080 - F.col("ch"), F.col("y")))).alias("cy"))


@query("fn_interpolate", "select video_id, track_id, t_ms, t_ms + 250 as at_ms, x + (nx - x) * 250.0 / (nt - t_ms) as value from (select *, lead(x) over w as nx, lead(t_ms) over w as nt from fx_samples window w as (partition by video_id, track_id order by t_ms)) t where nt is not null")
def fn_interpolate(fx_samples):
    """A value 250 ms after each sample, between it and the next."""
    w = Window.partitionBy("video_id", "track_id").orderBy("t_ms")
    n = fx_samples.withColumns({"nx": F.lead("x").over(w), "nt": F.lead("t_ms").over(w)}).where("nt is not null")
    return n.select("video_id", "track_id", "t_ms", (F.col("t_ms") + 250).alias("at_ms"), (F.col("x") + (F.col("nx") - F.col("x")) * F.lit(250.0) / (F.col("nt") - F.col("t_ms"))).alias("value"))


@query("fn_iso_date", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso from orders")
def fn_iso_date(orders):
    return orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("fn_cyclic_colour", "select video_id, cand, ['#FFFFFF', '#FFD400', '#00E5FF'][cand % 3 + 1] as colour from fx_candidates")
def fn_cyclic_colour(fx_candidates):
    return fx_candidates.select("video_id", "cand", F.element_at(F.array(*map(F.lit, ("#FFFFFF", "#FFD400", "#00E5FF"))), (F.col("cand") % 3 + 1).cast("int")).alias("colour"))


@query("agg_storage_rollup", "select coalesce(status, 'all') as status, coalesce(segment, 'all') as segment, sum(bytes)::bigint as bytes from (select status, case when clip_count > 0 then 'used' else 'empty' end as segment, storage_bytes as bytes from fx_projects) t group by rollup (status, segment)")
def agg_storage_rollup(fx_projects):
    """Bytes by status and use, with subtotals."""
    d = fx_projects.withColumn("segment", F.when(F.col("clip_count") > 0, "used").otherwise("empty"))
    return d.rollup("status", "segment").agg(F.sum("storage_bytes").alias("bytes")).select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("segment", F.lit("all")).alias("segment"), "bytes")
