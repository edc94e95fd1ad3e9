"""Tables on a shared time axis, derived from the given ones by SQL that both engines evaluate alike.

All times are integer milliseconds, and every table has ``video_id``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from timeloom.plans.scratch import listed

#: The 20 processing stages, in order.
STAGE_IDS = "audio vad transcription diarization highlights scenes faces tracking identity shots anchors camera transitions cut metadata captions export translation music thumbnails".split()


def _both(sql: str) -> tuple[str, str]:
    """Spark and DuckDB text: ``STRJOIN(a; b)`` joins a in the order of b, ``DIV(a; b)`` divides whole numbers, ``AT(list; n)`` is the n-th."""
    spark = re.sub(r"STRJOIN\(([^;]*); ([^)]*)\)", r"listagg(\1, ' ') within group (order by \2)", sql)
    duck = re.sub(r"STRJOIN\(([^;]*); ([^)]*)\)", r"string_agg(\1, ' ' order by \2)", sql)
    spark, duck = (re.sub(r"DIV\(([^;]*); (\d+)\)", rf"(\1) {op} \2", s) for s, op in ((spark, "div"), (duck, "//")))
    return spark, duck


_WORDS = """select video_id, idx, word, start_ms, start_ms + dur as end_ms, prob_pct, speaker from (
  select *, sum(dur + gap) over (partition by video_id order by idx) - dur - gap as start_ms from (
    select *, case when word like '%.' or word like '%?' then (case when (video_id + idx) % 3 = 0 then 1500 else 500 end) when word like '%,' then 300 else 40 end as gap from (
      select video_id, idx, 120 + 40 * least(length(word), 12) as dur, 40 + (video_id * 7 + idx * 13) % 60 as prob_pct,
        case when idx % 11 = 0 then null else 'S' || cast((DIV(idx; 40) + video_id) % 3 as string) end as speaker,
        case when word like '%.' and (video_id + idx) % 7 = 0 then left(word, length(word) - 1) || '?' else word end as word
      from (TOKENS) t) a) b) c"""
_TOKENS = (
    r"select doc_id as video_id, p.pos as idx, p.col as word from documents lateral view posexplode(filter(split(trim(text), '[ \t\n\r]+'), x -> x <> '')) p as pos, col",
    r"select doc_id as video_id, unnest(w) as word, unnest(range(len(w))) as idx from (select doc_id, list_filter(string_split_regex(trim(text), '[ \t\n\r]+'), lambda x: x <> '') as w from documents)",
)
_PROGRESS = "list_value(" + ", ".join(f"'{s}'" for s in STAGE_IDS) + ")"

_CANDIDATES = """select video_id, cand, 'T' || cast((video_id + cand) % 3 as string) as topic_id, start_ms, end_ms, text, word_count,
        (video_id * 37 + cand * 53) % 100 as score, 50 + (video_id * 11 + cand * 29) % 50 as retention, 1 + (video_id + cand) % 5 as standalone, 40 + (video_id * 3 + cand * 17) % 60 as boundary from (
      select video_id, cand, min(start_ms) as start_ms, max(end_ms) as end_ms, STRJOIN(text; seg_idx) as text, sum(word_count) as word_count from (
        HALVES) a
      group by video_id, cand) b"""
#: Each segment in its candidate and in the one before; in Spark exploded, so that segments are made once and stay where they are.
_HALVES = (
    "select s.*, c.cand from fx_segments s lateral view explode(if(seg_idx >= 4, array(seg_idx div 4, seg_idx div 4 - 1), array(seg_idx div 4))) c as cand",
    "select *, DIV(seg_idx; 4) as cand from fx_segments union all select *, DIV(seg_idx; 4) - 1 as cand from fx_segments where seg_idx >= 4",
)

FIXTURES: dict[str, tuple[str, str]] = {
    "fx_words": tuple(w.replace("TOKENS", t) for w, t in zip(_both(_WORDS), _TOKENS)),
    "fx_turns": _both("""select video_id, turn, speaker, text, start_ms, start_ms + dur as end_ms from (
      select *, sum(dur + gap) over (partition by video_id order by turn) - dur - gap as start_ms from (
        select conv_id as video_id, turn, role as speaker, case when (conv_id + turn) % 3 = 0 then text || '?' else text end as text,
          400 + 60 * length(text) as dur, case when (conv_id + turn) % 4 = 0 then 1400 else 250 end as gap from conversations where text is not null) a) b"""),
    "fx_turn_words": tuple(_both(w)[i] for i, w in enumerate((
        """select video_id, row_number() over (partition by video_id order by turn, pos) - 1 as idx, word, start_ms, start_ms + 60 * length(word) as end_ms from (
      select video_id, turn, pos, word, from_ms + 60 * (sum(length(word) + 1) over (partition by video_id, turn order by pos) - length(word) - 1) as start_ms from (
        select video_id, turn, start_ms as from_ms, p.pos as pos, p.col as word from fx_turns lateral view posexplode(filter(split(trim(text), '[ \\t\\n\\r]+'), x -> x <> '')) p as pos, col) a) b""",
        """select video_id, row_number() over (partition by video_id order by turn, pos) - 1 as idx, word, start_ms, start_ms + 60 * length(word) as end_ms from (
      select video_id, turn, pos, word, from_ms + 60 * (sum(length(word) + 1) over (partition by video_id, turn order by pos) - length(word) - 1) as start_ms from (
        select video_id, turn, from_ms, unnest(w) as word, unnest(range(len(w))) as pos from (select video_id, turn, start_ms as from_ms, list_filter(string_split_regex(trim(text), '[ \\t\\n\\r]+'), lambda x: x <> '') as w from fx_turns) t) a) b""",
    ))),
    "fx_segments": _both("""select video_id, seg_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, STRJOIN(word; idx) as text, count(*) as word_count from (
      select *, cast(coalesce(sum(case when word like '%.' or word like '%?' or word like '%!' then 1 else 0 end) over (partition by video_id order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as seg_idx from fx_words) a
      group by video_id, seg_idx"""),
    "fx_speech": _both("""select video_id, min(start_ms) as start_ms, max(end_ms) as end_ms from (
      select *, sum(case when start_ms - prev < 300 then 0 else 1 end) over (partition by video_id order by idx) as island from (
        select *, lag(end_ms, 1, -9999) over (partition by video_id order by idx) as prev from fx_words) a) b group by video_id, island"""),
    "fx_scenes": _both("""select video_id, row_number() over (partition by video_id order by start_ms) - 1 as scene_idx, start_ms, coalesce(lead(start_ms) over (partition by video_id order by start_ms), last_ms) as end_ms from (
      select video_id, case when idx = 0 then 0 else start_ms end as start_ms, max(end_ms) over (partition by video_id) as last_ms, idx, count(*) over (partition by video_id) as words from fx_words) a
      where words >= 30 and (idx = 0 or (video_id * 31 + idx) % 23 = 0)"""),
    "fx_samples": _both("""select * from (select DIV(user_id; 10) as video_id, user_id as track_id, event_id, event_type,
        500 * (row_number() over (partition by user_id order by ts, event_id) - 1) as t_ms, cast(floor(value * 3) as bigint) as x, event_id % 300 as y,
        60 + event_id % 400 as w, 120 + event_id % 700 as h, 20 + event_id % 80 as conf_pct from events) a where event_type <> 'error'"""),
    "fx_clips": _both("""select video_id, DIV(seg_idx; 5) + 1 as clip, min(start_ms) as start_ms, max(end_ms) as end_ms, STRJOIN(text; seg_idx) as text, cast(sum(word_count) as bigint) as word_count from fx_segments group by video_id, DIV(seg_idx; 5) + 1"""),
    "fx_candidates": tuple(_both(_CANDIDATES.replace("HALVES", h))[i] for i, h in enumerate(_HALVES)),
    "fx_progress": (
        """select event_id as seq, ts as emitted_at, user_id as job, case when event_id % 23 = 0 then 'pipeline' else element_at(array(STAGES), cast(event_id % 20 + 1 as int)) end as stage, case event_type when 'view' then 'running' when 'click' then 'complete' when 'signup' then 'started' when 'purchase' then 'skipped' else 'error' end as status, case when event_id % 11 <> 0 then event_id % 101 end as percent from events""".replace("STAGES", ", ".join(f"'{s}'" for s in STAGE_IDS)),
        """select event_id as seq, ts as emitted_at, user_id as job, case when event_id % 23 = 0 then 'pipeline' else list_extract(STAGES, event_id % 20 + 1) end as stage, case event_type when 'view' then 'running' when 'click' then 'complete' when 'signup' then 'started' when 'purchase' then 'skipped' else 'error' end as status, case when event_id % 11 <> 0 then event_id % 101 end as percent from events""".replace("STAGES", _PROGRESS),
    ),
    "fx_lines": _both("""select seq, emitted_at, job, case when status = 'error' then 'Error: stage ' || stage || ' failed' else '{"type":"progress","jobId":"' || cast(job as string) || '","stage":"' || stage || '","status":"' || status || '","percent":' || coalesce(cast(percent as string), 'null') || '}' end as line from fx_progress"""),
    "fx_replies": _both("""select video_id, case when cand % 11 = 10 then 'Sorry, no clips.' else 'Here you go: ```json {"start": ' || cast(case when cand % 5 = 4 then end_ms else start_ms end as string) || ', "end": ' || cast(case when cand % 5 = 4 then start_ms else end_ms end as string) || ', "score": ' || case when cand % 7 = 6 then '"high"' else cast(score as string) end || '}``` done' end as raw, cand from fx_candidates"""),
    "fx_probe": _both("""select p_partkey as video_id, '{"streams":[' || case when p_partkey % 6 = 0 then '' when p_partkey % 2 = 0 then '{"codec_type":"audio","codec_name":"aac"},' else '' end || '{"codec_type":"video","codec_name":"h264","width":' || cast(640 + p_size * 16 as string) || ',"avg_frame_rate":"' || case p_partkey % 3 when 0 then '30000/1001' when 1 then '25/1' else '0/0' end || '"}' || case when p_partkey % 6 <> 0 and p_partkey % 2 = 1 then ',{"codec_type":"audio","codec_name":"aac"}' else '' end || '],"format":{"duration":' || cast(p_size as string) || '}}' as json from part"""),
    "fx_assets": _both("""select 'uploads/' || cast(doc_id % 40 as string) || '/' || lang || '_' || cast(doc_id as string) || case doc_id % 4 when 0 then '.mp4' when 1 then '.mp3' when 2 then '.json' else '.png' end as path, doc_id % 40 as project, n_chars as length, doc_id * 1000 as mtime from documents"""),
    "fx_urls": _both("""select page_id, case page_id % 4 when 0 then 'https://video.example/watch?v=' when 1 then 'https://short.example/' when 2 then 'https://video.example/embed/' else 'https://other.example/x?id=' end || left(md5(url), 11) || case when page_id % 8 = 0 then '&t=5' else '' end as url from pages"""),
    "fx_projects": _both("""select c_custkey as job, c_name as name, case c_custkey % 4 when 0 then 'complete' when 1 then 'processing' when 2 then 'failed' else 'uploaded' end as status, count(o_orderkey) as clip_count, cast(coalesce(sum(floor(o_totalprice)), 0) as bigint) as storage_bytes, max(o_orderdate) as updated_at from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name"""),
}


#: Tables that are dealt by their key before their texts are cut into words: rows of words then need no shuffle of their own.
DEALT = {"fx_words": ("documents", "doc_id", ["doc_id", "text"])}
#: Bytes of a table's files in a part, if Spark shuffles into fewer parts than that makes: about half a million words, which a task can
#: sort more than once in memory (eight times as much was spilled).
PART_BYTES = 2_000_000


def dealt(table: DataFrame, path: str, key: str, columns: list[str]) -> DataFrame:
    """Columns of the table at ``path`` dealt and sorted by key. The number of parts grows with the table, so that a part's words
    have a fixed size, and isn't merged into fewer, as words take more room apart. Joins by the key and a bin then stay where the key is."""
    spark = table.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    size = listed(spark, path, "*.parquet").agg(F.sum("length")).first()[0] or 0
    return table.select(*columns).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), key).sortWithinPartitions(key)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one as a lazy DataFrame."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name][0]
    used = {n for n in re.findall(r"(?:from|join)\s+(\w+)", sql) if n in FIXTURES or n in ("documents", "conversations", "events", "part", "pages", "customer", "orders")}
    sql = re.sub(r"((?:from|join)\s+)(\w+)", lambda m: f"{m[1]}{{{m[2]}}}" if m[2] in used else m[0], sql.replace("{", "{{").replace("}", "}}"))
    tables = {n: fixture(spark, sf_dir, n) for n in used}
    if name in DEALT:
        table, key, columns = DEALT[name]
        tables[table] = dealt(tables[table], f"{sf_dir}/{table}.parquet", key, columns)
    return spark.sql(sql, **tables)
