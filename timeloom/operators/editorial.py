"""Blocks of talk: roles, importance, peaks, context, story and boundary scores, boundary refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from timeloom.functions import columns as C
from timeloom.operators.candidates import greedy_keep, nms_sql
from timeloom.operators.intervals import nearest
from timeloom.operators.windows import by_idx, by_turn, sentence_bounds, sentence_words
from timeloom.plans.catalog import query
from timeloom.plans.scratch import materialise

# Fixed values of the role rules; replaceable by callers.
CONCLUSIONS, TRANSITIONS = "in conclusion|to sum up|finally|at last", "moving on|anyway|next up"
ROLE_WEIGHTS = {"hook": 0.35, "question": 0.25, "answer": 0.30, "conclusion": 0.30, "story": 0.25, "joke": 0.25, "explanation": 0.20, "rebuttal": 0.25, "transition": -0.15, "monologue_statement": 0.05}


def block_role(text: Column, guest: Column) -> Column:
    """Ordered rules on a block's text; statements of a guest are answers."""
    low = F.lower(text)
    return (
        F.when(text.contains("?") | C.is_question_starter(text), "question").when(low.rlike(CONCLUSIONS), "conclusion").when(low.rlike(TRANSITIONS), "transition")
        .when(low.contains("secret"), "explanation").when(low.contains("i remember") | low.contains("when i was"), "story").when(guest, "answer").otherwise("monologue_statement")
    )


_FIRST = "regexp_extract(lower(text), '[a-z0-9'']+')"
_QS = ", ".join(f"'{w}'" for w in C.QUESTION_STARTERS)
_FP = ", ".join(f"'{w}'" for w in C.FLOATING_PRONOUNS)
_CN = ", ".join(f"'{w}'" for w in C.CONNECTORS)
_ROLE = f"case when contains(text, '?') or {_FIRST} in ({_QS}) then 'question' when regexp_matches(lower(text), '{CONCLUSIONS}') then 'conclusion' when regexp_matches(lower(text), '{TRANSITIONS}') then 'transition' when contains(lower(text), 'secret') then 'explanation' when contains(lower(text), 'i remember') or contains(lower(text), 'when i was') then 'story' when speaker = 'user' then 'answer' else 'monologue_statement' end"


@query("score_block_role", f"select video_id, turn, {_ROLE} as role from fx_turns")
def score_block_role(fx_turns):
    return fx_turns.select("video_id", "turn", block_role(F.col("text"), F.col("speaker") == "user").alias("role"))


def information_density(text: Column, ms: Column) -> Column:
    """Distinct words other than stop words per minute."""
    return F.size(F.filter(F.array_distinct(C.tokens(text)), lambda t: ~t.isin(C.STOP_WORDS))) * 60000.0 / F.greatest(ms, F.lit(1))


def block_importance(role: Column, emotion: Column, density: Column, confidence: Column) -> Column:
    weight = F.lit(0.0)
    for k, v in ROLE_WEIGHTS.items():
        weight = F.when(role == k, F.lit(v)).otherwise(weight)
    return C.clamp(0.5 + weight + emotion * 0.15 + F.when(density > 100, 0.15).when(density > 60, 0.10).otherwise(0.0) - F.when(confidence < 0.70, 0.20).otherwise(0.0), 0.0, 1.0)


def turns_scored(fx_turns: DataFrame) -> DataFrame:
    role = block_role(F.col("text"), F.col("speaker") == "user")
    emotion, conf = (F.col("turn") % 5) / 4.0, 0.5 + (F.col("video_id") % 5) / 10.0
    b = fx_turns.withColumns({"role": role, "emotion": emotion, "conf": conf, "density": information_density(F.col("text"), F.col("end_ms") - F.col("start_ms"))})
    b = b.withColumn("importance", block_importance(F.col("role"), F.col("emotion"), F.col("density"), F.col("conf")))
    hot = F.when(F.col("role").isin("question", "hook", "story", "joke", "rebuttal"), 0.3).otherwise(0.0)
    return b.withColumn("peak", F.floor((F.col("importance") * 0.4 + F.col("emotion") * 0.3 + hot) * 100 + 0.5) / 100.0)


_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
_W = " ".join(f"when '{k}' then {v:.2f}" for k, v in ROLE_WEIGHTS.items())
_BLOCKS = f"""b0 as (select *, {_ROLE} as role, (turn % 5) / 4.0 as emotion, 0.5 + (video_id % 5) / 10.0 as conf, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')), lambda t: t not in ({_STOP}))) * 60000.0 / greatest(end_ms - start_ms, 1) as density from fx_turns),
b1 as (select *, greatest(0.0, least(1.0, 0.5 + case role {_W} else 0.0 end + emotion * 0.15 + case when density > 100 then 0.15 when density > 60 then 0.10 else 0.0 end - case when conf < 0.70 then 0.20 else 0.0 end)) as importance from b0),
b as (select *, floor((importance * 0.4 + emotion * 0.3 + case when role in ('question', 'hook', 'story', 'joke', 'rebuttal') then 0.3 else 0.0 end) * 100 + 0.5) / 100.0 as peak from b1)"""


@query("score_block_importance", f"with {_BLOCKS} select video_id, turn, density, importance from b")
def score_block_importance(fx_turns):
    return turns_scored(fx_turns).select("video_id", "turn", "density", "importance")


@query("score_peak", f"with {_BLOCKS} select video_id, turn, peak from b where peak >= 0.55")
def score_peak(fx_turns):
    return turns_scored(fx_turns).where("peak >= 0.55").select("video_id", "turn", "peak")


def peak_clusters(peaks: DataFrame, near_ms: int = 25_000) -> DataFrame:
    """``video_id, cluster, n, centre``: in time order each peak joins the first cluster whose moving mean is near, else opens one."""
    kind = "array<struct<n:bigint,total:double>>"

    def step(cl, t):
        hit = F.array_position(F.transform(cl, lambda c: F.abs(t - c["total"] / c["n"]) <= near_ms), True)
        grown = F.transform(cl, lambda c, i: F.when(i + 1 == hit, F.struct((c["n"] + 1).alias("n"), (c["total"] + t).alias("total"))).otherwise(c))
        new = F.array_append(cl, F.struct(F.lit(1).cast("long").alias("n"), t.cast("double").alias("total")))
        return F.when(hit > 0, grown).otherwise(new).cast(kind)

    times = F.sort_array(F.collect_list(F.col("start_ms").cast("double")))
    g = peaks.groupBy("video_id").agg(F.aggregate(times, F.array().cast(kind), step).alias("c"))
    return g.select("video_id", F.posexplode("c").alias("cluster", "x")).select("video_id", "cluster", "x.n", (F.col("x.total") / F.col("x.n")).alias("centre"))


@query("win_peak_cluster", f"""with recursive {_BLOCKS}, o as (select video_id, start_ms::double as t, row_number() over (partition by video_id order by start_ms) as k from b where peak >= 0.55),
g as (select video_id, k, [{{'n': 1::bigint, 'total': t}}] as c from o where k = 1 union all select g.video_id, o.k, case when h.i > 0 then list_transform(g.c, lambda x, j: case when j = h.i then {{'n': x.n + 1, 'total': x.total + o.t}} else x end) else list_append(g.c, {{'n': 1::bigint, 'total': o.t}}) end from g join o on o.video_id = g.video_id and o.k = g.k + 1, lateral (select coalesce(list_position(list_transform(g.c, lambda x: abs(o.t - x.total / x.n) <= 25000), true), 0) as i) h)
select video_id, i::int as cluster, c[i + 1].n as n, c[i + 1].total / c[i + 1].n as centre from (select video_id, c, unnest(range(len(c))) as i from (select video_id, arg_max(c, k) as c from g group by video_id) x) y""")
def win_peak_cluster(fx_turns):
    return peak_clusters(turns_scored(fx_turns).where("peak >= 0.55"))


@query("gen_context_expand", f"""with {_BLOCKS}, p as (select *, lag(role) over w as prev_role, lag(start_ms) over w as prev_start from b window w as (partition by video_id order by turn))
select video_id, turn, case when prev_start is not null and ((role = 'answer' and prev_role = 'question') or {_FIRST} in ({_FP}) or end_ms - start_ms < 6000) then prev_start else start_ms end as from_ms,
concat_ws('; ', case when prev_start is not null and role = 'answer' and prev_role = 'question' then 'question' end, case when prev_start is not null and {_FIRST} in ({_FP}) then 'pronoun' end, case when prev_start is not null and end_ms - case when (role = 'answer' and prev_role = 'question') or {_FIRST} in ({_FP}) then prev_start else start_ms end < 6000 then 'duration' end) as reasons from p""")
def gen_context_expand(fx_turns):
    """The previous block is taken in before an answer to its question, a floating pronoun, or a block that is too short."""
    b = turns_scored(fx_turns).withColumns({"pr": F.lag("role").over(by_turn()), "ps": F.lag("start_ms").over(by_turn())})
    there = F.col("ps").isNotNull()
    asked, vague = there & (F.col("role") == "answer") & (F.col("pr") == "question"), there & C.has_floating_pronoun(F.col("text"))
    start = F.when(asked | vague, F.col("ps")).otherwise(F.col("start_ms"))
    brief = there & (F.col("end_ms") - start < 6000)
    why = F.concat_ws("; ", F.when(asked, "question"), F.when(vague, "pronoun"), F.when(brief, "duration"))
    return b.select("video_id", "turn", F.when(brief, F.col("ps")).otherwise(start).alias("from_ms"), why.alias("reasons"))


def story_score(text: Column, main_point: Column) -> Column:
    words = F.filter(F.split(text, " "), lambda w: w != "")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    hook, context = ~C.has_floating_pronoun(first), (F.size(words) >= 30) & ~C.is_connector(first)
    n = F.when(hook, 30).otherwise(0) + F.when(context, 20).otherwise(0) + F.when(main_point, 30).otherwise(0) + F.when(C.sentence_final(last), 20).otherwise(0)
    return n / 100.0


_STORY = f"(case when {_FIRST} not in ({_FP}) then 30 else 0 end + case when word_count >= 30 and {_FIRST} not in ({_CN}) then 20 else 0 end + case when score >= 55 then 30 else 0 end + case when regexp_matches(text, '[.?!]$') then 20 else 0 end) / 100.0"


@query("score_story", f"select video_id, cand, {_STORY} as story from (select *, regexp_extract(text, '^[^ ]*') as fw from fx_candidates) t where regexp_matches(lower(fw), '[a-z0-9'']')")
def score_story(fx_candidates):
    """Hook 30, context 20, main point 30, payoff 20 per cent."""
    c = fx_candidates.where(F.lower(F.regexp_extract("text", "^[^ ]*", 0)).rlike("[a-z0-9']"))
    return c.select("video_id", "cand", story_score(F.col("text"), F.col("score") >= 55).alias("story"))


def boundary_columns(words: DataFrame) -> DataFrame:
    """Words with the evidence for starting before and ending after them."""
    final = C.sentence_final(F.col("word"))
    return words.withColumns({
        "opens": F.coalesce(F.lag(final).over(by_idx()), F.lit(True)), "gap_before": F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by_idx()), F.lit(0)),
        "closes": final, "gap_after": F.coalesce(F.lead("start_ms").over(by_idx()) - F.col("end_ms"), F.lit(0)), "connector": C.is_connector(F.col("word")), "pronoun": C.has_floating_pronoun(F.col("word")),
    })


def _points(*rules: tuple[Column, float, float]) -> Column:
    total = F.lit(0.5)
    for test, yes, no in rules:
        total = total + F.when(test, F.lit(yes)).otherwise(F.lit(no))
    return C.clamp(total, 0.0, 1.0)


def start_confidence(penalties: bool = True) -> Column:
    return _points((F.col("opens"), 0.25, 0.0), (F.col("gap_before") >= 400, 0.20, 0.0), (~F.col("pronoun"), 0.15, -0.15 if penalties else 0.0), (~F.col("connector"), 0.10, -0.15 if penalties else 0.0))


def end_confidence(penalties: bool = True) -> Column:
    return _points((F.col("closes"), 0.30, 0.0), (F.col("gap_after") >= 500, 0.20, 0.0), (~F.col("connector"), 0.10, -0.20 if penalties else 0.0))


_TOK = "regexp_extract(lower(word), '[a-z0-9'']+')"
_BC = f"e as (select *, coalesce(regexp_matches(lag(word) over w, '[.?!]$'), true) as opens, coalesce(start_ms - lag(end_ms) over w, 0) as gb, regexp_matches(word, '[.?!]$') as closes, coalesce(lead(start_ms) over w - end_ms, 0) as ga, {_TOK} in ({_CN}) as conn, {_TOK} in ({_FP}) as pron from fx_words window w as (partition by video_id order by idx))"


def _sql_points(kind: str, penalty: bool) -> str:
    if kind == "start":
        return f"greatest(0.0, least(1.0, 0.5 + case when opens then 0.25 else 0.0 end + case when gb >= 400 then 0.20 else 0.0 end + case when not pron then 0.15 else {-0.15 if penalty else 0.0} end + case when not conn then 0.10 else {-0.15 if penalty else 0.0} end))"
    return f"greatest(0.0, least(1.0, 0.5 + case when closes then 0.30 else 0.0 end + case when ga >= 500 then 0.20 else 0.0 end + case when not conn then 0.10 else {-0.2 if penalty else 0.0} end))"


@query("score_boundary_start", f"with {_BC} select video_id, idx, {_sql_points('start', True)} as conf from e")
def score_boundary_start(fx_words):
    return boundary_columns(fx_words).select("video_id", "idx", start_confidence().alias("conf"))


@query("score_boundary_end", f"with {_BC} select video_id, idx, {_sql_points('end', True)} as conf, {_sql_points('start', True)} * 0.45 + {_sql_points('end', True)} * 0.55 as overall from e")
def score_boundary_end(fx_words):
    return boundary_columns(fx_words).select("video_id", "idx", end_confidence().alias("conf"), (start_confidence() * 0.45 + end_confidence() * 0.55).alias("overall"))


@query("score_boundary_eval", f"with {_BC} select video_id, idx, {_sql_points('start', False)} as start_conf, {_sql_points('end', False)} as end_conf from e")
def score_boundary_eval(fx_words):
    """The variants of refinement, without penalties."""
    return boundary_columns(fx_words).select("video_id", "idx", start_confidence(False).alias("start_conf"), end_confidence(False).alias("end_conf"))


@query("score_editorial_quality", "select video_id, cand, greatest(0.0, least(1.0, boundary / 100.0 * 0.35 + score / 100.0 * 0.25 + retention / 100.0 * 0.15 + standalone / 5.0 * 0.15 + retention / 100.0 * 0.10)) as quality from fx_candidates")
def score_editorial_quality(fx_candidates):
    c = F.col
    return fx_candidates.select("video_id", "cand", C.clamp(c("boundary") / 100.0 * 0.35 + c("score") / 100.0 * 0.25 + c("retention") / 100.0 * 0.15 + c("standalone") / 5.0 * 0.15 + c("retention") / 100.0 * 0.10, 0.0, 1.0).alias("quality"))


def refine_ends(words: DataFrame) -> DataFrame:
    """For each word as a boundary: where a start and an end would move in one round. A start moves from a connector, a
    floating pronoun or an unsure word to an earlier one; an end moves on to the sentence's end or past an unsure word."""
    b = sentence_bounds(boundary_columns(words))
    b = b.withColumns({"prev_s": F.lag("sentence_start").over(by_idx()), "prev3_s": F.lag("sentence_start", 3).over(by_idx()), "prev_w": F.lag("start_ms").over(by_idx()), "next_e": F.lead("end_ms").over(by_idx())})
    first_s = F.min("start_ms").over(Window.partitionBy("video_id"))
    unsure = F.col("prob_pct") < 60
    start = F.when(F.col("connector") & F.col("prev_s").isNotNull(), F.col("prev_s")).when(F.col("pronoun") & F.col("prev_w").isNotNull(), F.coalesce("prev3_s", first_s)).when(unsure & F.col("prev_w").isNotNull(), F.col("prev_w")).otherwise(F.col("start_ms"))
    end = F.when(~F.col("closes") & (F.col("sentence_end") > F.col("end_ms")) & (F.col("sentence_end") - F.col("end_ms") <= 8000), F.col("sentence_end")).when(unsure & F.col("closes") & F.col("next_e").isNotNull(), F.col("next_e")).otherwise(F.col("end_ms"))
    return b.withColumns({"start_to": start, "end_to": end})


_BND = _BC + """, f as (select *, coalesce(opens or gb > 1200, true) as o, closes or ga > 1200 or lead(idx) over (partition by video_id order by idx) is null as c from e),
sb as (select *, max(case when o then start_ms end) over (partition by video_id order by idx) as s, min(case when c then end_ms end) over (partition by video_id order by idx rows between current row and unbounded following) as z from f),
rf as (select *, lag(s) over w as ps, lag(s, 3) over w as p3, lag(start_ms) over w as pw, lead(end_ms) over w as ne, min(start_ms) over (partition by video_id) as fs from sb window w as (partition by video_id order by idx))"""


@query("gen_refine_start", f"with {_BND} select video_id, idx, (case when conn and ps is not null then ps when pron and pw is not null then coalesce(p3, fs) when prob_pct < 60 and pw is not null then pw else start_ms end)::bigint as start_to from rf")
def gen_refine_start(fx_words):
    return refine_ends(fx_words).select("video_id", "idx", "start_to")


@query("gen_refine_end", f"with {_BND} select video_id, idx, (case when not closes and z > end_ms and z - end_ms <= 8000 then z when prob_pct < 60 and closes and ne is not null then ne else end_ms end)::bigint as end_to from rf")
def gen_refine_end(fx_words):
    return refine_ends(fx_words).select("video_id", "idx", "end_to")


START_RULES, END_RULES = ("opens", "long_before", "no_pronoun", "no_connector"), ("closes", "long_after", "no_connector")


def _mark(at: str, tests: tuple[str, ...]) -> Column:
    """A time and what speaks for a boundary there as one number (the time shifted by four bits), null without a time."""
    return F.shiftleft(F.col(at).cast("long"), 4).bitwiseOR(sum((F.when(F.col(t), 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("long"))


def boundary_moves(words: DataFrame, rounds: int) -> DataFrame:
    """Each word as a boundary: ``video_id, idx, start_ms, end_ms, starts, ends``; ``starts[n]`` is the ``_mark`` of the start that its
    own is after n moves of ``refine_ends``, up to ``rounds``; ``ends`` likewise. A move goes to a word that a frame of the video
    reaches (an opening, a neighbour, the first), so that word's moves are carried from there: words are sorted once for starts
    and once, backwards, for ends, and never joined. Times must not decrease with ``idx``."""
    w = words.select("video_id", "idx", "start_ms", "end_ms", (F.col("prob_pct") < 60).alias("unsure"), C.sentence_final(F.col("word")).alias("closes"), C.first_token(F.col("word")).alias("_t"))
    w = w.select("*", F.col("_t").isin(C.CONNECTORS).alias("connector"), F.col("_t").isin(C.FLOATING_PRONOUNS).alias("pronoun")).drop("_t")
    by, back = by_idx(), Window.partitionBy("video_id").orderBy(F.desc("idx"))
    before, before3, own = (by.rowsBetween(Window.unboundedPreceding, n) for n in (-1, -3, 0))
    later = back.rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumns({"_f": F.lag("closes").over(by), "_p": F.lag("end_ms").over(by), "_w": F.lag("start_ms").over(by), "_n": F.lead("start_ms").over(by), "_e": F.lead("end_ms").over(by), "_i": F.lead("idx").over(by)})
    # openings and closings as in sentence_bounds, where only words with a time count
    opening = F.coalesce(F.col("_f") | (F.col("start_ms") - F.col("_p") > 1200), F.lit(True)) & F.col("start_ms").isNotNull()
    closing = (F.coalesce(F.col("closes") | (F.col("_n") - F.col("end_ms") > 1200), F.lit(True)) | F.col("_i").isNull()) & F.col("end_ms").isNotNull()
    tests = {"opens": F.coalesce("_f", F.lit(True)), "long_before": F.col("start_ms") - F.col("_p") >= 400, "no_pronoun": ~F.col("pronoun"), "no_connector": ~F.col("connector"), "long_after": F.col("_n") - F.col("end_ms") >= 500}
    w = w.withColumns(tests | {"_opening": opening, "_closing": closing})
    w = w.select("video_id", "idx", "start_ms", "end_ms", "unsure", "closes", "connector", "pronoun", "_w", "_e", "_opening", "_closing", _mark("start_ms", START_RULES).alias("s0"), _mark("end_ms", END_RULES).alias("e0"))
    for n in range(rounds):
        mark = F.col(f"s{n}")
        there = F.when(F.col("_opening"), mark)
        # marks of: the opening of the word before, that of the word three before or else the first word, the word before
        w = w.withColumns({"_1": F.last(there, True).over(before), "_3": F.last(there, True).over(before3), "_a": F.first(mark, True).over(own), "_0": F.lag(mark).over(by)})
        if n == 0:
            w = w.withColumn("_go", F.when(F.col("connector") & F.col("_1").isNotNull(), 1).when(F.col("pronoun") & F.col("_w").isNotNull(), 3).when(F.col("unsure") & F.col("_w").isNotNull(), 0))
        w = w.withColumn(f"s{n + 1}", F.when(F.col("_go") == 1, F.col("_1")).when(F.col("_go") == 3, F.coalesce("_3", "_a")).when(F.col("_go") == 0, F.col("_0")).otherwise(mark)).drop("_0", "_1", "_3", "_a")
    starts = [f"s{n}" for n in range(rounds + 1)]
    w = w.select("video_id", "idx", "start_ms", "end_ms", "unsure", "closes", "_e", "_closing", *starts, "e0")
    for n in range(rounds):
        mark = F.col(f"e{n}")
        w = w.withColumns({"_1": F.last(F.when(F.col("_closing"), mark), True).over(later), "_0": F.lag(mark).over(back)})
        if n == 0:
            far = F.shiftright("_1", 4) - F.col("end_ms")
            w = w.withColumn("_go", F.when(~F.col("closes") & (far > 0) & (far <= 8000), 1).when(F.col("unsure") & F.col("closes") & F.col("_e").isNotNull(), 0))
        w = w.withColumn(f"e{n + 1}", F.when(F.col("_go") == 1, F.col("_1")).when(F.col("_go") == 0, F.col("_0")).otherwise(mark)).drop("_0", "_1")
    return w.select("video_id", "idx", "start_ms", "end_ms", F.array(*starts).alias("starts"), F.array(*[f"e{n}" for n in range(rounds + 1)]).alias("ends"))


def refine_boundaries(clips: DataFrame, words: DataFrame, rounds: int = 3, good: float = 0.85, gain: float = 0.02) -> DataFrame:
    """Up to ``rounds`` passes that move a clip's ends as ``refine_ends`` says; a clip stops when its boundary confidence
    is good or a pass after the first gains too little. A word knows all its moves (``boundary_moves``), so the few that begin or end
    where a clip does are kept, and the passes are unrolled on clips alone; words stay where they are. Of words that begin (or end)
    at one time the first counts; a moved end stays with the word that it moved to."""
    keys, c = clips.columns, F.col

    def sides(*more: str) -> Column:
        """Start and end as rows of their own: ``side, at`` and ``moves``."""
        return F.explode(F.array(*[F.struct(F.lit(k).alias("side"), c(at).alias("at"), *[c(m).alias("moves") for m in more[k : k + 1]]) for k, at in enumerate(("start_ms", "end_ms"))])).alias("x")

    # written, as they are read three times: for the times of starts and of ends, and to be moved
    l = materialise(clips.withColumn("_row", F.monotonically_increasing_id()), "clips")
    r = boundary_moves(words, rounds)
    for at in ("start_ms", "end_ms"):
        r = r.join(l.select("video_id", at, F.lit(True).alias(f"_{at}")).distinct().hint("shuffle_hash"), ["video_id", at], "left")
    r = r.where("_start_ms or _end_ms").select("video_id", "idx", sides("starts", "ends")).select("video_id", "idx", "x.*")
    j = l.select(*keys, "_row", sides()).select(*keys, "_row", "x.*").hint("shuffle_hash").join(r, ["video_id", "side", "at"], "left")
    moves = lambda k: F.min_by(F.when(c("side") == k, c("moves")), F.when(c("side") == k, c("idx")))
    j = j.groupBy("video_id", "_row").agg(*[F.first(k).alias(k) for k in keys if k != "video_id"], moves(0).alias("_s"), moves(1).alias("_e"))
    j = j.withColumns({"s": c("start_ms"), "e": c("end_ms"), "done": F.lit(False), "rounds": F.lit(0), "conf": F.lit(0.0)})
    holds = lambda mark, i: mark.bitwiseAND(F.lit(1 << i)) > 0
    for n in range(rounds):
        s, e = c("_s")[n], c("_e")[n]
        sure = _points(*[(holds(s, i), yes, 0.0) for i, yes in enumerate((0.25, 0.20, 0.15, 0.10))]), _points(*[(holds(e, i), yes, 0.0) for i, yes in enumerate((0.30, 0.20, 0.10))])
        # where no word begins (or ends) it stays 0.5; a clip that is done keeps its ends, so their confidence stays too
        j = j.withColumn("_now", F.when(c("done"), c("conf")).otherwise(sure[0] * 0.45 + sure[1] * 0.55))
        j = j.withColumn("done", c("done") | (c("_now") >= good) | ((F.lit(n) > 1) & (c("_now") - c("conf") < gain)))
        moved = lambda end, marks: F.when(c("done"), c(end)).otherwise(F.coalesce(F.shiftright(c(marks)[n + 1], 4), end))
        j = j.withColumns({"s": moved("s", "_s"), "e": moved("e", "_e"), "rounds": c("rounds") + F.when(c("done"), 0).otherwise(1), "conf": c("_now")})
    return j.select(*keys, "s", "e", "done", "rounds", "conf")


def _refine_sql(rounds: int = 3) -> str:
    ctes = f"""{_BND}, rr as (select video_id, start_ms, end_ms, {_sql_points('start', False)} as cs, {_sql_points('end', False)} as ce,
      case when conn and ps is not null then ps when pron and pw is not null then coalesce(p3, fs) when prob_pct < 60 and pw is not null then pw else start_ms end as st,
      case when not closes and z > end_ms and z - end_ms <= 8000 then z when prob_pct < 60 and closes and ne is not null then ne else end_ms end as et from rf),
    c0 as (select video_id, clip, start_ms, end_ms, start_ms as s, end_ms as e, false as done, 0 as rounds, 0.0 as conf from fx_clips)"""
    for n in range(rounds):
        ctes += f""", d{n} as (select c.*, x.st, y.et, coalesce(x.cs, 0.5) * 0.45 + coalesce(y.ce, 0.5) * 0.55 as now from c{n} c left join rr x on x.video_id = c.video_id and x.start_ms = c.s left join rr y on y.video_id = c.video_id and y.end_ms = c.e),
    c{n + 1} as (select video_id, clip, start_ms, end_ms, case when k then s else coalesce(st, s) end as s, case when k then e else coalesce(et, e) end as e, k as done, rounds + (not k)::int as rounds, now as conf from (select *, done or now >= 0.85 or ({n} > 1 and now - conf < 0.02) as k from d{n}) t)"""
    return f"with {ctes} select * from c{rounds}"


@query("gen_boundary_refine", _refine_sql())
def gen_boundary_refine(fx_clips, fx_words):
    return refine_boundaries(fx_clips.select("video_id", "clip", "start_ms", "end_ms"), fx_words)


@query("gen_candidates", f"with {_BLOCKS} select video_id, turn, start_ms as from_ms, end_ms as to_ms, importance, peak, end_ms - start_ms <= 30000 as fits from b")
def gen_candidates(fx_turns):
    """Blocks as candidates with scores and whether they fit."""
    return turns_scored(fx_turns).select("video_id", "turn", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"), "importance", "peak", (F.col("end_ms") - F.col("start_ms") <= 30000).alias("fits"))


#: Roles whose blocks carry a point of their own; fixed values.
POINT_ROLES = ["question", "hook", "story", "joke", "rebuttal"]


def led_clusters(peaks: DataFrame, near_ms: int = 25_000) -> DataFrame:
    """``peak_clusters`` with the peak that leads each (the best, of equals the first): ``video_id, cluster, at_ms, pointed``.
    ``peaks`` hold ``start_ms, peak`` and ``pointed`` (whether the block carries a main point)."""
    kind = "array<struct<n:bigint,total:double,peak:double,at_ms:bigint,pointed:boolean>>"

    def step(cl, p):
        t = p["start_ms"].cast("double")
        hit = F.array_position(F.transform(cl, lambda c: F.abs(t - c["total"] / c["n"]) <= near_ms), True)
        lead = lambda c: p["peak"] > c["peak"]
        taken = lambda c: F.struct((c["n"] + 1).alias("n"), (c["total"] + t).alias("total"), F.greatest(c["peak"], p["peak"]).alias("peak"), F.when(lead(c), p["start_ms"]).otherwise(c["at_ms"]).alias("at_ms"), F.when(lead(c), p["pointed"]).otherwise(c["pointed"]).alias("pointed"))
        new = F.struct(F.lit(1).cast("long").alias("n"), t.alias("total"), p["peak"].alias("peak"), p["start_ms"].alias("at_ms"), p["pointed"].alias("pointed"))
        return F.when(hit > 0, F.transform(cl, lambda c, i: F.when(i + 1 == hit, taken(c)).otherwise(c))).otherwise(F.array_append(cl, new)).cast(kind)

    rows = F.sort_array(F.collect_list(F.struct(F.col("start_ms").cast("long").alias("start_ms"), F.col("peak").cast("double").alias("peak"), "pointed")))
    g = peaks.where("start_ms is not null and peak is not null").groupBy("video_id").agg(F.aggregate(rows, F.array().cast(kind), step).alias("c"))
    return g.select("video_id", F.posexplode("c").alias("cluster", "x")).select("video_id", "cluster", "x.at_ms", "x.pointed")


def peak_subcandidates(blocks: DataFrame, words: DataFrame, least_peak: float = 0.55, oversized_ms: int = 90_000, min_ms: int = 20_000, max_ms: int = 60_000, complete: float = 0.70) -> DataFrame:
    """Story-complete windows inside talks that are too long for one clip: ``video_id, kept, cand, start_ms, end_ms, completeness``.

    Peaks of a talk over ``oversized_ms`` form clusters. From the best peak of each, a window begins 18 s before and ends 40 s
    after its begin, both snapped to the sentence around the nearest word where that is within 10 s; it must last
    ``min_ms`` to ``max_ms`` and be complete (hook 30, context 20, main point 30, payoff 20 per cent). Of windows that
    overlap by more than 0.35 of their hull the more complete stays, of equals the earlier cluster's. Talks without
    words or peaks give no rows."""
    talk = blocks.groupBy("video_id").agg(F.min("start_ms").alias("talk_start"), F.max("end_ms").alias("talk_end")).where(F.col("talk_end") - F.col("talk_start") > oversized_ms)
    pointed = (F.col("importance") >= 0.55) | (F.col("emotion") >= 0.40) | F.col("role").isin(POINT_ROLES)
    c = led_clusters(blocks.where(F.col("peak") >= least_peak).withColumn("pointed", pointed)).join(talk, "video_id")
    w = sentence_words(words).select("video_id", "start_ms", "end_ms", "idx", "word", "opening", "closing")
    w = materialise(w.select("video_id", F.col("start_ms").alias("w_ms"), F.struct("start_ms", "end_ms", "idx", "word", "opening", "closing").alias("w")), "turn-words")
    c = nearest(c.withColumn("from_ms", F.greatest("talk_start", F.col("at_ms") - 18_000)), w, "from_ms", "w_ms", ["w"])
    own = lambda at: F.struct(F.col(f"w.{at}").alias("at_ms"), F.col("w.idx").alias("idx"), F.col("w.word").alias("word"))
    c = c.withColumn("first", F.when(F.col("w.start_ms") - F.col("w.opening.at_ms") <= 10_000, F.col("w.opening")).otherwise(own("start_ms"))).drop("w", "w_ms")
    c = nearest(c.withColumn("to_ms", F.least("talk_end", F.col("first.at_ms") + 40_000)), w, "to_ms", "w_ms", ["w"])
    c = c.withColumn("last", F.when(F.col("w.closing.at_ms") - F.col("w.end_ms") <= 10_000, F.col("w.closing")).otherwise(own("end_ms")))
    c = c.select("video_id", F.col("cluster").alias("cand"), "pointed", "first", "last", F.col("first.at_ms").alias("start_ms"), F.col("last.at_ms").alias("end_ms"))
    c = c.where((F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms))
    starter = F.col("first.word")
    context = (F.col("last.idx") - F.col("first.idx") >= 29) & ~C.is_connector(starter)
    points = [(~C.has_floating_pronoun(starter), 30), (context, 20), (F.col("pointed"), 30), (C.sentence_final(F.col("last.word")), 20)]
    c = c.withColumn("completeness", sum((F.when(t, n).otherwise(0) for t, n in points), F.lit(0)) / 100.0).where(F.col("completeness") >= complete)
    clash = lambda k, r: C.iou_hull(k["start_ms"], k["end_ms"], r["start_ms"], r["end_ms"]) > 0.35
    return greedy_keep(c, ["video_id"], [-F.col("completeness"), F.col("cand")], ["cand", "start_ms", "end_ms", "completeness"], clash)


_NEAR = "(select arg_min({{'a': w.start_ms, 'z': w.end_ms, 'i': w.idx, 'w': w.word, 'oa': w.o.a, 'oi': w.o.i, 'ow': w.o.w, 'ca': w.c.a, 'ci': w.c.i, 'cw': w.c.w}}, (abs(w.start_ms - {at}), w.start_ms)) from tw w where w.video_id = {row}.video_id)"


@query("gen_peak_subcandidates", f"""with recursive {_BLOCKS}, talk as (select video_id, min(start_ms) as a, max(end_ms) as z from fx_turns group by video_id having max(end_ms) - min(start_ms) > 90000),
po as (select video_id, start_ms::bigint as at_ms, start_ms::double as t, peak::double as peak, (importance >= 0.55 or emotion >= 0.40 or role in ('question', 'hook', 'story', 'joke', 'rebuttal')) as pointed, row_number() over (partition by video_id order by start_ms) as k from b where peak >= 0.55),
pg as (select video_id, k, [{{'n': 1::bigint, 'total': t, 'peak': peak, 'at_ms': at_ms, 'pointed': pointed}}] as c from po where k = 1
 union all select pg.video_id, po.k, case when h.i > 0 then list_transform(pg.c, lambda x, j: case when j = h.i then {{'n': x.n + 1, 'total': x.total + po.t, 'peak': greatest(x.peak, po.peak), 'at_ms': case when po.peak > x.peak then po.at_ms else x.at_ms end, 'pointed': case when po.peak > x.peak then po.pointed else x.pointed end}} else x end)
  else list_append(pg.c, {{'n': 1::bigint, 'total': po.t, 'peak': po.peak, 'at_ms': po.at_ms, 'pointed': po.pointed}}) end
  from pg join po on po.video_id = pg.video_id and po.k = pg.k + 1, lateral (select coalesce(list_position(list_transform(pg.c, lambda x: abs(po.t - x.total / x.n) <= 25000), true), 0) as i) h),
pc as (select x.video_id, i::int as cand, c[i + 1].at_ms as at_ms, c[i + 1].pointed as pointed, talk.a, talk.z from (select video_id, c, unnest(range(len(c))) as i from (select video_id, arg_max(c, k) as c from pg group by video_id) y) x join talk on talk.video_id = x.video_id),
tf as (select *, coalesce(regexp_matches(lag(word) over v, '[.?!]$') or start_ms - lag(end_ms) over v > 1200, true) as o1, coalesce(regexp_matches(word, '[.?!]$') or lead(start_ms) over v - end_ms > 1200, true) or lead(idx) over v is null as c1 from fx_turn_words window v as (partition by video_id order by idx)),
tw as (select *, last_value(case when o1 then {{'a': start_ms, 'i': idx, 'w': word}} end ignore nulls) over (partition by video_id order by idx) as o, first_value(case when c1 then {{'a': end_ms, 'i': idx, 'w': word}} end ignore nulls) over (partition by video_id order by idx rows between current row and unbounded following) as c from tf),
p1 as (select pc.*, {_NEAR.format(at="greatest(pc.a, pc.at_ms - 18000)", row="pc")} as n from pc),
p2 as (select video_id, cand, pointed, z, case when n.a - n.oa <= 10000 then n.oa else n.a end as s, case when n.a - n.oa <= 10000 then n.oi else n.i end as si, case when n.a - n.oa <= 10000 then n.ow else n.w end as word from p1 where n is not null),
p3 as (select p2.*, {_NEAR.format(at="least(p2.z, p2.s + 40000)", row="p2")} as n from p2),
p4 as (select video_id, cand, pointed, s, si, word, {_TOK} as first_token, case when n.ca - n.z <= 10000 then n.ca else n.z end as e, case when n.ca - n.z <= 10000 then n.ci else n.i end as ei, case when n.ca - n.z <= 10000 then n.cw else n.w end as ew from p3),
pw as (select video_id, cand, s::bigint as start_ms, e::bigint as end_ms, (case when first_token not in ({_FP}) then 30 else 0 end + case when ei - si >= 29 and first_token not in ({_CN}) then 20 else 0 end + case when pointed then 30 else 0 end + case when regexp_matches(ew, '[.?!]$') then 20 else 0 end) / 100.0 as completeness from p4 where e - s between 20000 and 60000),
pq as (select * from pw where completeness >= 0.70),
{nms_sql('pq', 'completeness desc, cand', 'greatest(0, least(k.e, t.end_ms) - greatest(k.s, t.start_ms)) / greatest(100, greatest(k.e, t.end_ms) - least(k.s, t.start_ms)) > 0.35')}
select r.video_id, kept::int as kept, k.c as cand, k.s as start_ms, k.e as end_ms, pq.completeness from r join pq on pq.video_id = r.video_id and pq.cand = k.c""")
def gen_peak_subcandidates(fx_turns, fx_turn_words):
    return peak_subcandidates(turns_scored(fx_turns), fx_turn_words)


@query("gen_llm_selection", r"""with j as (select r.video_id, r.cand, json_extract(j, '$.start')::bigint as s, json_extract(j, '$.end')::bigint as e, greatest(1, least(100, coalesce(try_cast(json_extract_string(j, '$.score') as int), 70))) as score from (select *, nullif(regexp_extract(raw, '(?s)(\{.*\})', 1), '')::json as j from fx_replies) r where j is not null)
select video_id, cand, s as start_ms, least(e, s + 30000)::bigint as end_ms, score from (select *, row_number() over (partition by video_id order by score desc, cand) as n from j where e > s) t where n <= 5""")
def gen_llm_selection(fx_replies):
    """Valid picks of the model's replies, clamped to 30 s, the five best."""
    from timeloom.operators.projections import parse_reply

    d = fx_replies.withColumn("j", parse_reply(F.col("raw"))).where("j is not null and j.end > j.start")
    d = d.select("video_id", "cand", F.col("j.start").alias("start_ms"), F.least("j.end", F.col("j.start") + 30_000).alias("end_ms"), C.clamp(F.coalesce(F.expr("try_cast(j.score as int)"), F.lit(70)), 1, 100).alias("score"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "cand"))).where("n <= 5").drop("n")
