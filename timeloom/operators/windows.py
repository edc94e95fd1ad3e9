"""Window functions: neighbours, islands, gap filling, smoothing, cues and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from timeloom.functions import columns as C
from timeloom.operators.intervals import as_right, interval_join
from timeloom.plans.catalog import query


def by_idx():
    return Window.partitionBy("video_id").orderBy("idx")


def by_turn():
    return Window.partitionBy("video_id").orderBy("turn")


def by_track():
    return Window.partitionBy("video_id", "track_id").orderBy("t_ms")


def islands(df: DataFrame, starts: Column, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Number the runs of rows that begin where ``starts`` holds."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order)))


@query("win_neighbor_ids", "select video_id, turn, lag(turn) over w as previous_id, lead(turn) over w as next_id from fx_turns window w as (partition by video_id order by turn)")
def win_neighbor_ids(fx_turns):
    return fx_turns.select("video_id", "turn", F.lag("turn").over(by_turn()).alias("previous_id"), F.lead("turn").over(by_turn()).alias("next_id"))


@query("win_memory", "select video_id, turn, lag(speaker, 1, '') over w as before_1, lag(speaker, 2, '') over w as before_2, lead(speaker, 1, '') over w as after_1, lead(speaker, 2, '') over w as after_2 from fx_turns window w as (partition by video_id order by turn)")
def win_memory(fx_turns):
    """What stands one and two blocks before and after, empty at the edges."""
    return fx_turns.select("video_id", "turn", *[f("speaker", n, "").over(by_turn()).alias(f"{name}_{n}") for f, name in ((F.lag, "before"), (F.lead, "after")) for n in (1, 2)])


#: Roles that a block after a question turns from into its answer.
ANSWERING = ["statement", "answer", "explanation"]


def qa_links(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``role, linked``: questions link to the next block, whatever it is; a statement, answer or explanation after one is its answer and links back."""
    w = Window.partitionBy(*keys).orderBy(order)
    answer = (F.lag("role").over(w) == "question") & F.col("role").isin(ANSWERING)
    return blocks.select(*keys, order, F.when(answer, "answer").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "question", F.lead(order).over(w)).when(answer, F.lag(order).over(w)).alias("linked"))


_TURN_ROLE = "case when contains(text, '?') then 'question' when length(text) % 5 = 0 then 'statement' when length(text) % 5 = 1 then 'explanation' when length(text) % 5 = 2 then 'answer' else 'story' end"


@query("win_qa_link", f"with r as (select video_id, turn, {_TURN_ROLE} as role from fx_turns) select video_id, turn, case when lag(role) over w = 'question' and role in ('statement', 'answer', 'explanation') then 'answer' else role end as role, case when role = 'question' then lead(turn) over w when lag(role) over w = 'question' and role in ('statement', 'answer', 'explanation') then lag(turn) over w end as linked from r window w as (partition by video_id order by turn)")
def win_qa_link(fx_turns):
    n = F.length("text") % 5
    role = F.when(F.col("text").contains("?"), "question").when(n == 0, "statement").when(n == 1, "explanation").when(n == 2, "answer").otherwise("story")
    return qa_links(fx_turns.select("video_id", "turn", role.alias("role")), ["video_id"], "turn")


@query("win_silence_gap", "select video_id, idx, coalesce(start_ms - lag(end_ms) over w, 0)::bigint as before_ms, coalesce(lead(start_ms) over w - end_ms, 0)::bigint as after_ms from fx_words window w as (partition by video_id order by idx)")
def win_silence_gap(fx_words):
    return fx_words.select("video_id", "idx", F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by_idx()), F.lit(0)).alias("before_ms"), F.coalesce(F.lead("start_ms").over(by_idx()) - F.col("end_ms"), F.lit(0)).alias("after_ms"))


BLOCK_GAP, BLOCK_MAX = 1200, 15_000


def block_segmentation(words: DataFrame) -> DataFrame:
    """``video_id, idx, block``: blocks begin at a change of speaker (missing speakers filled forward), after a pause of
    1.2 s, and after a sentence end once the block is over 15 s long. The last rule needs the block's own start, so it
    is folded within the islands of the first two, which keeps each fold short."""
    w = words.withColumn("who", F.last("speaker", True).over(by_idx()))
    cut = (F.col("start_ms") - F.lag("end_ms").over(by_idx()) >= BLOCK_GAP) | ~F.col("who").eqNullSafe(F.lag("who").over(by_idx()))
    w = islands(w.withColumn("_cut", F.coalesce(cut, F.lit(False))), F.col("_cut"), ["video_id"], ["idx"])
    rows = F.sort_array(F.collect_list(F.struct("idx", "start_ms", "end_ms", C.sentence_final(F.col("word")).alias("final"))))
    state = F.struct(F.lit(-1).cast("long").alias("from_ms"), F.lit(0).cast("int").alias("part"), F.lit(False).alias("due"), F.array().cast("array<int>").alias("parts"))

    def step(s, r):
        part = F.when(s["due"], s["part"] + 1).otherwise(s["part"])
        start = F.when(s["due"] | (s["from_ms"] < 0), r["start_ms"].cast("long")).otherwise(s["from_ms"])
        return F.struct(start.alias("from_ms"), part.alias("part"), (r["final"] & (r["end_ms"] - start > BLOCK_MAX)).alias("due"), F.array_append(s["parts"], part).alias("parts"))

    folded = w.groupBy("video_id", "island").agg(rows.alias("r")).withColumn("p", F.aggregate("r", state, step, lambda s: s["parts"]))
    flat = folded.select("video_id", "island", F.explode(F.arrays_zip("r", "p")).alias("z")).select("video_id", F.col("z.r.idx").alias("idx"), "island", F.col("z.p").alias("part"))
    return islands(flat, F.coalesce((F.col("island") != F.lag("island").over(by_idx())) | (F.col("part") != F.lag("part").over(by_idx())), F.lit(True)), ["video_id"], ["idx"], "block").select("video_id", "idx", "block")


@query("win_block_segmentation", """with recursive a as (select *, last_value(speaker ignore nulls) over (partition by video_id order by idx) as who from fx_words), b as (select *, coalesce(start_ms - lag(end_ms) over w >= 1200 or who is distinct from lag(who) over w, false) as cut from a window w as (partition by video_id order by idx)),
i as (select *, sum(cut::int) over (partition by video_id order by idx) as island from b), r as (select *, row_number() over (partition by video_id, island order by idx) as n from i),
f as (select video_id, island, n, idx, 0 as part, start_ms as from_ms, regexp_matches(word, '[.?!]$') and end_ms - start_ms > 15000 as due from r where n = 1
 union all select r.video_id, r.island, r.n, r.idx, f.part + f.due::int, x.s, regexp_matches(r.word, '[.?!]$') and r.end_ms - x.s > 15000 from f join r on r.video_id = f.video_id and r.island = f.island and r.n = f.n + 1, lateral (select case when f.due then r.start_ms else f.from_ms end as s) x),
k as (select video_id, sum(c) over (partition by video_id order by idx) as block from (select *, case when part is distinct from lag(part) over w or island is distinct from lag(island) over w then 1 else 0 end as c from f window w as (partition by video_id order by idx)) y)
select video_id, count(*) as words, max(block)::bigint as blocks, sum(block)::bigint as block_sum from k group by all""")
def win_block_segmentation(fx_words):
    return block_segmentation(fx_words).groupBy("video_id").agg(F.count("*").alias("words"), F.max("block").alias("blocks"), F.sum("block").alias("block_sum"))


@query("win_silence_complement", "with s as (select video_id, start_ms, end_ms, lag(end_ms, 1, 0) over (partition by video_id order by start_ms) as prev from fx_speech) select video_id, prev::bigint as start_ms, start_ms as end_ms from s where start_ms - prev >= 100 union all select video_id, max(end_ms)::bigint, max(end_ms) + 700 from fx_speech group by video_id")
def win_silence_complement(fx_speech):
    """Gaps of 100 ms and more between speech, with the head and the tail of the video (here 700 ms longer)."""
    prev = F.lag("end_ms", 1, 0).over(Window.partitionBy("video_id").orderBy("start_ms"))
    gaps = fx_speech.withColumn("p", prev).where("start_ms - p >= 100").select("video_id", F.col("p").alias("start_ms"), F.col("start_ms").alias("end_ms"))
    return gaps.unionByName(fx_speech.groupBy("video_id").agg(F.max("end_ms").alias("start_ms"), (F.max("end_ms") + 700).alias("end_ms")))


def sentence_bounds(words: DataFrame) -> DataFrame:
    """Each word with the start of its sentence and the end, sentences being cut at final punctuation and pauses over 1.2 s."""
    opens = F.coalesce(F.lag(C.sentence_final(F.col("word"))).over(by_idx()) | (F.col("start_ms") - F.lag("end_ms").over(by_idx()) > 1200), F.lit(True))
    closes = F.coalesce(C.sentence_final(F.col("word")) | (F.lead("start_ms").over(by_idx()) - F.col("end_ms") > 1200), F.lit(True))
    back = Window.partitionBy("video_id").orderBy(F.desc("idx"))
    w = words.withColumns({"_o": F.when(opens, F.col("start_ms")), "_c": F.when(closes | F.lead("idx").over(by_idx()).isNull(), F.col("end_ms"))})
    return w.withColumns({"sentence_start": F.last("_o", True).over(by_idx().rowsBetween(Window.unboundedPreceding, 0)), "sentence_end": F.last("_c", True).over(back.rowsBetween(Window.unboundedPreceding, 0))}).drop("_o", "_c")


def sentence_words(words: DataFrame) -> DataFrame:
    """Each word with the first and the last word of its sentence, as structs ``opening`` and ``closing`` of ``at_ms, idx, word``
    (the opening's start, the closing's end); sentences are cut as in ``sentence_bounds``."""
    opens = F.coalesce(F.lag(C.sentence_final(F.col("word"))).over(by_idx()) | (F.col("start_ms") - F.lag("end_ms").over(by_idx()) > 1200), F.lit(True))
    closes = F.coalesce(C.sentence_final(F.col("word")) | (F.lead("start_ms").over(by_idx()) - F.col("end_ms") > 1200), F.lit(True))
    back = Window.partitionBy("video_id").orderBy(F.desc("idx"))
    own = lambda at: F.struct(F.col(at).alias("at_ms"), "idx", "word")
    w = words.withColumns({"_o": F.when(opens, own("start_ms")), "_c": F.when(closes | F.lead("idx").over(by_idx()).isNull(), own("end_ms"))})
    return w.withColumns({"opening": F.last("_o", True).over(by_idx().rowsBetween(Window.unboundedPreceding, 0)), "closing": F.last("_c", True).over(back.rowsBetween(Window.unboundedPreceding, 0))}).drop("_o", "_c")


_BOUNDS = """f as (select *, coalesce(regexp_matches(lag(word) over w, '[.?!]$') or start_ms - lag(end_ms) over w > 1200, true) as o, coalesce(regexp_matches(word, '[.?!]$') or lead(start_ms) over w - end_ms > 1200, true) or lead(idx) over w is null as c from fx_words window w as (partition by video_id order by idx)),
b as (select *, max(case when o then start_ms end) over (partition by video_id order by idx) as s, min(case when c then end_ms end) over (partition by video_id order by idx rows between current row and unbounded following) as e from f)"""


@query("win_sentence_bounds", f"with {_BOUNDS} select video_id, idx, s as sentence_start, e as sentence_end from b")
def win_sentence_bounds(fx_words):
    return sentence_bounds(fx_words).select("video_id", "idx", "sentence_start", "sentence_end")


def sentence_snap(clips: DataFrame, words: DataFrame, back_ms: int = 15_000, ahead_ms: int = 20_000) -> DataFrame:
    """Clips from their first word's sentence start to their last word's sentence end, unless that is too far away."""
    b = sentence_bounds(words)
    j = interval_join(clips, as_right(b, idx="idx", s="sentence_start", e="sentence_end"))
    ends = j.groupBy(*clips.columns).agg(F.min_by("s", "idx").alias("s"), F.max_by("e", "idx").alias("e"))
    return ends.withColumns({"s": F.when(F.col("start_ms") - F.col("s") <= back_ms, F.col("s")).otherwise(F.col("start_ms")), "e": F.when(F.col("e") - F.col("end_ms") <= ahead_ms, F.col("e")).otherwise(F.col("end_ms"))})


@query("win_sentence_snap", f"with {_BOUNDS}, k as (select video_id, clip, start_ms + 700 as a, end_ms - 700 as z from fx_clips) select k.video_id, k.clip, case when a - arg_min(s, idx) <= 15000 then arg_min(s, idx) else a end as s, case when arg_max(e, idx) - z <= 20000 then arg_max(e, idx) else z end as e from k join b on b.video_id = k.video_id and b.end_ms > a and b.start_ms < z group by k.video_id, k.clip, a, z")
def win_sentence_snap(fx_clips, fx_words):
    c = fx_clips.select("video_id", "clip", (F.col("start_ms") + 700).alias("start_ms"), (F.col("end_ms") - 700).alias("end_ms"))
    return sentence_snap(c, fx_words).select("video_id", "clip", "s", "e")


def trailing_median3(value: str, window) -> Column:
    """Median of up to three trailing values of a window (of two, the upper)."""
    got = F.sort_array(F.collect_list(value).over(window.rowsBetween(-2, 0)))
    return F.element_at(got, (F.floor(F.size(got) / 2) + 1).cast("int"))


_ISLE = "m as (select *, case when conf_pct < 30 then null else x end as v, sum(case when conf_pct < 30 then 1 else 0 end) over (partition by video_id, track_id order by t_ms) as isle from fx_samples)"


@query("win_rolling_median3", f"with {_ISLE}, k as (select *, list_sort(list(v) over (partition by video_id, track_id, isle order by t_ms rows between 2 preceding and current row)) as l from m where v is not null) select video_id, track_id, t_ms, l[len(l) // 2 + 1] as smooth from k")
def win_rolling_median3(fx_samples):
    """Trailing median of three, starting anew after a null."""
    d = fx_samples.withColumn("v", F.when(F.col("conf_pct") >= 30, F.col("x")))
    d = islands(d, F.col("v").isNull(), ["video_id", "track_id"], ["t_ms"]).where("v is not null")
    w = Window.partitionBy("video_id", "track_id", "island").orderBy("t_ms")
    return d.select("video_id", "track_id", "t_ms", trailing_median3("v", w).alias("smooth"))


def merge_adjacent(df: DataFrame, keys: list[str], order: str, label: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Runs of rows with the same label as one row each."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = islands(df, F.coalesce(~F.col(label).eqNullSafe(F.lag(label).over(w)), F.lit(True)) | F.lag(F.lit(1)).over(w).isNull(), keys, [order])
    return d.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.first(label).alias(label), F.count("*").alias("n")).drop("island")


@query("win_merge_adjacent", "with a as (select *, (scene_idx * 7 + video_id) % 3 as label from fx_scenes), b as (select *, sum(case when label is distinct from p then 1 else 0 end) over (partition by video_id order by scene_idx) as k from (select *, lag(label) over (partition by video_id order by scene_idx) as p from a) x) select video_id, min(start_ms)::bigint as start_ms, max(end_ms) as end_ms, min(label) as label, count(*) as n from b group by video_id, k")
def win_merge_adjacent(fx_scenes):
    d = fx_scenes.withColumn("label", (F.col("scene_idx") * 7 + F.col("video_id")) % 3)
    return merge_adjacent(d, ["video_id"], "scene_idx", "label")


@query("win_rank", "select video_id, cand, row_number() over (partition by video_id order by floor(score / 10.0) desc, retention desc, score desc, cand) as rank from fx_candidates")
def win_rank(fx_candidates):
    """By score bucket, diversity, score and input order."""
    w = Window.partitionBy("video_id").orderBy(F.desc(F.floor(F.col("score") / 10.0)), F.desc("retention"), F.desc("score"), "cand")
    return fx_candidates.select("video_id", "cand", F.row_number().over(w).alias("rank"))


@query("win_velocity", "select video_id, track_id, t_ms, case when last_value(t_ms) over w = first_value(t_ms) over w then 0.0 else (last_value(x) over w - first_value(x) over w) * 1000.0 / (last_value(t_ms) over w - first_value(t_ms) over w) end as velocity from fx_samples window w as (partition by video_id, track_id order by t_ms rows between 4 preceding and 4 following)")
def win_velocity(fx_samples):
    """Central difference over four rows to each side, clamped at the edges."""
    w = by_track().rowsBetween(-4, 4)
    dt = F.last("t_ms").over(w) - F.first("t_ms").over(w)
    return fx_samples.select("video_id", "track_id", "t_ms", F.when(dt == 0, 0.0).otherwise((F.last("x").over(w) - F.first("x").over(w)) * F.lit(1000.0) / dt).alias("velocity"))


@query("win_transition_events", """with l as (select video_id, start_ms as t, (scene_idx * 5 + video_id) % 4 as layout from fx_scenes), b as (select video_id, t, 'boundary' as kind from (select *, lag(layout) over (partition by video_id order by t) as p from l) x where p is not null and p <> layout), c as (select video_id, start_ms + 100 as t, 'cut' as kind from fx_scenes where scene_idx > 0 and scene_idx % 2 = 0)
select * , case kind when 'cut' then 0 else 600 end as duration_ms from (select * from b union all select * from c where not exists (select 1 from b where b.video_id = c.video_id and abs(b.t - c.t) <= 250)) u""")
def win_transition_events(fx_scenes):
    """Scene cuts and layout boundaries; a boundary takes the place of cuts within 250 ms; duration by kind."""
    w = Window.partitionBy("video_id").orderBy("scene_idx")
    lay = fx_scenes.withColumn("layout", (F.col("scene_idx") * 5 + F.col("video_id")) % 4)
    b = lay.withColumn("p", F.lag("layout").over(w)).where("p is not null and p <> layout").select("video_id", F.col("start_ms").alias("t"), F.lit("boundary").alias("kind"))
    c = fx_scenes.where("scene_idx > 0 and scene_idx % 2 = 0").select("video_id", (F.col("start_ms") + 100).alias("t"), F.lit("cut").alias("kind"))
    near = interval_join(c.withColumns({"start_ms": F.col("t") - 250, "end_ms": F.col("t") + 250}), b.select("video_id", F.col("t").alias("r_start"), F.col("t").alias("r_end")), "closed")
    cuts = c.join(near.select("video_id", "t"), ["video_id", "t"], "left_anti")
    return b.unionByName(cuts).withColumn("duration_ms", F.when(F.col("kind") == "cut", 0).otherwise(600))


@query("win_cut_keyframes", """with cuts as (select distinct video_id, (t_ms // 5000 * 5000 + 333)::bigint as t_ms from fx_samples), k as (select video_id, t_ms, min(x) as x from fx_samples group by all)
select * from (select video_id, t_ms::bigint as t_ms, x, false as inserted from k union all select c.video_id, c.t_ms, k.x, true from cuts c asof left join k on k.video_id = c.video_id and k.t_ms >= c.t_ms where not exists (select 1 from k where k.video_id = c.video_id and k.t_ms in (c.t_ms - 1, c.t_ms, c.t_ms + 1))) u where x is not null""")
def win_cut_keyframes(fx_samples):
    """At each cut a copy of the next frame, unless a frame is within 1 ms."""
    s = fx_samples
    k = s.groupBy("video_id", "t_ms").agg(F.min("x").alias("x")).withColumn("inserted", F.lit(False))
    cuts = s.select("video_id", (F.floor(F.col("t_ms") / 5000) * 5000 + 333).cast("long").alias("t_ms")).distinct()
    both = k.unionByName(cuts.withColumns({"x": F.lit(None).cast("long"), "inserted": F.lit(True)}))
    w = Window.partitionBy("video_id").orderBy("t_ms", F.desc("inserted"))
    back = Window.partitionBy("video_id").orderBy(F.desc("t_ms"), "inserted").rowsBetween(Window.unboundedPreceding, 0)
    near = F.least(F.col("t_ms") - F.lag(F.when(~F.col("inserted"), F.col("t_ms"))).over(w), F.lead(F.when(~F.col("inserted"), F.col("t_ms"))).over(w) - F.col("t_ms"))
    filled = both.withColumns({"_near": near, "x": F.when(F.col("inserted"), F.last("x", True).over(back)).otherwise(F.col("x"))})
    return filled.where("x is not null and not (inserted and coalesce(_near, 99) <= 1)").select("video_id", "t_ms", "x", "inserted")


def chunk_words(words: DataFrame, size: int) -> DataFrame:
    """Caption cues: every ``size`` words, and at sentence ends."""
    opens = F.coalesce(F.lag(C.sentence_final(F.col("word"))).over(by_idx()), F.lit(True))
    d = islands(words, opens, ["video_id"], ["idx"], "sentence")
    nth = F.row_number().over(Window.partitionBy("video_id", "sentence").orderBy("idx")) - 1
    return d.withColumn("part", F.floor(nth / size))


_CHUNK = "s as (select *, sum(case when regexp_matches(p, '[.?!]$') or p is null then 1 else 0 end) over (partition by video_id order by idx) as sentence from (select *, lag(word) over (partition by video_id order by idx) as p from fx_words) x), k as (select *, ((row_number() over (partition by video_id, sentence order by idx) - 1) // 4)::bigint as part from s)"


@query("win_chunk_words", f"with {_CHUNK} select video_id, sentence::bigint as sentence, part, string_agg(word, ' ' order by idx) as cue, count(*) as n from k group by all")
def win_chunk_words(fx_words):
    k = chunk_words(fx_words, 4)
    cue = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    return k.groupBy("video_id", "sentence", "part").agg(cue.alias("cue"), F.count("*").alias("n"))


@query("win_cue_timing", f"with {_CHUNK}, c as (select video_id, sentence, part, min(start_ms) as a, max(end_ms) as z from k group by all) select video_id, a as start_ms, least(greatest(z, a + 400), coalesce(lead(a) over (partition by video_id order by a), 999999999999))::bigint as end_ms from c")
def win_cue_timing(fx_words):
    """A cue lasts to its last word, 0.4 s at least, and never into the next."""
    c = chunk_words(fx_words, 4).groupBy("video_id", "sentence", "part").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z"))
    return c.select("video_id", F.col("a").alias("start_ms"), F.least(F.greatest(F.col("z"), F.col("a") + 400), F.lead("a").over(Window.partitionBy("video_id").orderBy("a"))).alias("end_ms"))


@query("win_change_only", "select video_id, track_id, t_ms, x from (select *, lag(x // 40) over (partition by video_id, track_id order by t_ms) as p from fx_samples) t where (x // 40) is distinct from p")
def win_change_only(fx_samples):
    v = F.floor(F.col("x") / 40)
    return fx_samples.withColumn("v", v).withColumn("p", F.lag("v").over(by_track())).where(~F.col("v").eqNullSafe(F.col("p"))).select("video_id", "track_id", "t_ms", "x")


@query("win_recenter_common", "select video_id, track_id, t_ms, m as w, greatest(0, least(1920 - m, x + (w - m) // 2))::bigint as x from (select *, min(w) over (partition by video_id, track_id) as m from fx_samples) t")
def win_recenter_common(fx_samples):
    """The smallest window of a clip for all its frames, centred in each and kept inside."""
    m = F.min("w").over(Window.partitionBy("video_id", "track_id"))
    return fx_samples.withColumn("m", m).select("video_id", "track_id", "t_ms", F.col("m").alias("w"), F.greatest(F.lit(0), F.least(1920 - F.col("m"), F.col("x") + F.floor((F.col("w") - F.col("m")) / 2))).alias("x"))


@query("win_frame_delta", "select video_id, track_id, t_ms, x - lag(x) over w as dx, y - lag(y) over w as dy from fx_samples window w as (partition by video_id, track_id order by t_ms)")
def win_frame_delta(fx_samples):
    return fx_samples.select("video_id", "track_id", "t_ms", *[(F.col(c) - F.lag(c).over(by_track())).alias("d" + c) for c in "xy"])


@query("win_body_displacement", "select video_id, track_id, t_ms, sqrt(pow(x - lag(x) over w, 2.0) + pow(y - lag(y) over w, 2.0)) as moved from fx_samples window w as (partition by video_id, track_id order by t_ms)")
def win_body_displacement(fx_samples):
    d = lambda c: F.pow(F.col(c) - F.lag(c).over(by_track()), 2.0)
    return fx_samples.select("video_id", "track_id", "t_ms", F.sqrt(d("x") + d("y")).alias("moved"))


@query("set_boundaries", "with p as (select video_id, clip, start_ms as t from fx_clips union select video_id, clip, end_ms from fx_clips union select c.video_id, c.clip, s.start_ms from fx_clips c join fx_scenes s on s.video_id = c.video_id and s.start_ms > c.start_ms and s.start_ms < c.end_ms) select * from (select video_id, clip, t as from_ms, lead(t) over (partition by video_id, clip order by t) as to_ms from p) x where to_ms is not null")
def set_boundaries(fx_clips, fx_scenes):
    """Clip ends and cuts as a sorted set of times, paired with their successors."""
    cuts = interval_join(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), as_right(fx_scenes)).where("r_start > start_ms and r_start < end_ms").select("video_id", "clip", F.col("r_start").alias("t"))
    p = fx_clips.select("video_id", "clip", F.explode(F.array("start_ms", "end_ms")).alias("t")).union(cuts).distinct()
    return p.select("video_id", "clip", F.col("t").alias("from_ms"), F.lead("t").over(Window.partitionBy("video_id", "clip").orderBy("t")).alias("to_ms")).where("to_ms is not null")


@query("limit_keyframes", "with r as (select *, row_number() over (partition by video_id order by t_ms, event_id) - 1 as i, count(*) over (partition by video_id) as n from fx_samples) select video_id, event_id from r where n <= 90 or i in (select (k * n) // 90 from range(90) t(k))")
def limit_keyframes(fx_samples):
    """Ninety rows per video at most, evenly spread."""
    n = F.count("*").over(Window.partitionBy("video_id"))
    r = fx_samples.withColumns({"i": F.row_number().over(Window.partitionBy("video_id").orderBy("t_ms", "event_id")) - 1, "n": n})
    k = F.ceil(F.col("i") * 90 / F.col("n"))
    return r.where((F.col("n") <= 90) | ((F.floor(k * F.col("n") / 90) == F.col("i")) & (k < 90))).select("video_id", "event_id")


@query("limit_last_n", "select job, seq from (select job, seq, row_number() over (partition by job order by seq desc) as n from fx_lines) t where n <= 80")
def limit_last_n(fx_lines):
    return fx_lines.withColumn("n", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("seq")))).where("n <= 80").select("job", "seq")


@query("sort_recent", "select job, updated_at from fx_projects order by updated_at desc nulls last, job")
def sort_recent(fx_projects):
    return fx_projects.select("job", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "job")


@query("ext_session_words", "select video_id, count(*) as words, min(start_ms)::bigint as start_ms from (select *, sum(case when start_ms - p >= 1200 or p is null then 1 else 0 end) over (partition by video_id order by start_ms) as s from (select *, lag(start_ms) over (partition by video_id order by start_ms) as p from fx_words) a) b group by video_id, s")
def ext_session_words(fx_words):
    """Extension: word streams closed by a gap of 1.2 s between starts, with session windows."""
    d = fx_words.select("video_id", F.timestamp_millis("start_ms").alias("ts"))
    return d.groupBy("video_id", F.session_window("ts", "1200 milliseconds").alias("s")).agg(F.count("*").alias("words")).select("video_id", "words", F.unix_millis("s.start").alias("start_ms"))


@query("ext_tumbling_zones", "select video_id, (start_ms // 120000 * 120000)::bigint as zone_ms, count(*) as words from fx_words group by all")
def ext_tumbling_zones(fx_words):
    """Extension: words per 120 s zone, with tumbling windows."""
    d = fx_words.select("video_id", F.timestamp_millis("start_ms").alias("ts"))
    return d.groupBy("video_id", F.window("ts", "120 seconds").alias("w")).agg(F.count("*").alias("words")).select("video_id", F.unix_millis("w.start").alias("zone_ms"), "words")
