"""Progress events of jobs: parsing, and the state of each job as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timeloom.plans.catalog import query
from timeloom.sources.fixtures import STAGE_IDS

EVENT = "type string, jobId string, stage string, status string, percent int"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``kind`` (progress, error or log), ``stage``, ``status`` and ``percent`` to rows with a ``line``; works on streams."""
    j = F.when(F.col("line").startswith("{"), F.from_json("line", EVENT))
    d = lines.withColumn("_j", j)
    kind = F.when(F.col("_j.stage").isNotNull(), "progress").when(F.lower("line").rlike("error|exception"), "error").otherwise("log")
    return d.withColumns({"kind": kind, "stage": F.col("_j.stage"), "status": F.col("_j.status"), "percent": F.col("_j.percent")}).drop("_j")


@query("stream_parse", "select seq, case when line like '{%' then 'progress' when regexp_matches(lower(line), 'error|exception') then 'error' else 'log' end as kind, case when line like '{%' then json_extract_string(line, '$.stage') end as stage, case when line like '{%' then json_extract(line, '$.percent')::int end as percent from fx_lines")
def stream_parse(fx_lines):
    return parse_lines(fx_lines).select("seq", "kind", "stage", "percent")


def ordinal(stage):
    return F.array_position(F.array(*map(F.lit, STAGE_IDS)), stage)


_ORD = "list_position([" + ", ".join(f"'{s}'" for s in STAGE_IDS) + "], stage)"


PIPELINE = "pipeline"


def stage_history(events: DataFrame) -> DataFrame:
    """``job, seq, o, s, state, percent``: after each event of a job, each of the twenty stages with its state and percent.

    An event of a stage completes every earlier one. Its own stage is complete, running or failed by the event's status
    (other statuses leave it); a stage's percent never falls, and is 100 once complete. ``pipeline`` is no stage. Events
    become twenty short rows each, in windows over a stage of a job.
    """
    own = F.when(F.col("status") == "complete", "complete").when(F.col("status").isin("started", "running"), "running").when(F.col("status").isin("failed", "error"), "failed")
    stages = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i + 1).alias("o")) for i, s in enumerate(STAGE_IDS)])
    e = events.select("job", "seq", ordinal(F.col("stage")).alias("at"), own.alias("own"), "percent", F.explode(stages).alias("x")).select("job", "seq", "at", "own", "percent", "x.*")
    news = F.when(F.col("o") < F.col("at"), "complete").when(F.col("o") == F.col("at"), F.col("own"))
    e = e.withColumn("news", news)
    w = Window.partitionBy("job", "o").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.when(F.col("news") == "complete", 100).when(F.col("news") == "running", F.coalesce("percent", F.lit(0))).otherwise(0)
    return e.select("job", "seq", "o", "s", F.coalesce(F.last("news", True).over(w), F.lit("pending")).alias("state"), F.max(gain).over(w).alias("percent"))


def stage_states(events: DataFrame) -> DataFrame:
    """``job, stage, state, percent`` of each of the twenty stages after the last event (see ``stage_history``)."""
    last = stage_history(events).groupBy("job", F.col("s").alias("stage")).agg(F.max_by(F.struct("state", "percent"), "seq").alias("x"))
    return last.select("job", "stage", "x.state", "x.percent")


_STAGE = f"""ev as (select job, seq, {_ORD} as place, case when status = 'complete' then 'complete' when status in ('started', 'running') then 'running' when status in ('failed', 'error') then 'failed' end as own, percent from fx_progress),
ex as (select ev.*, d.stage as s, d.o + 1 as o, case when d.o + 1 < place then 'complete' when d.o + 1 = place then own end as news from ev cross join (select unnest([{", ".join(f"'{s}'" for s in STAGE_IDS)}]) as stage, unnest(range(20)) as o) d),
h as (select job, seq, o, s, coalesce(last_value(news ignore nulls) over w, 'pending') as state, max(case when news = 'complete' then 100 when news = 'running' then coalesce(percent, 0) else 0 end) over w as percent from ex window w as (partition by job, o order by seq))"""


@query("stream_stage_state", f"with {_STAGE} select job, s as stage, arg_max(state, seq) as state, arg_max(percent, seq)::int as percent from h group by all")
def stream_stage_state(fx_progress):
    return stage_states(fx_progress)


def job_states(events: DataFrame) -> DataFrame:
    """``job, percent, status, stage`` after the last event: the stage it named; a percent that never falls, from the events or,
    where they have none, from the share of complete stages; a status that only events of the ``pipeline`` itself set to
    running or complete, and any failure to failed (idle before that)."""
    done = stage_history(events).groupBy("job", "seq").agg(F.floor(F.count(F.when(F.col("state") == "complete", 1)) * 100 / len(STAGE_IDS)).alias("done"))
    whole = F.col("stage") == PIPELINE
    status = F.when(whole & (F.col("status") == "complete"), "complete").when(whole & F.col("status").isin("started", "running"), "running").when(F.col("status").isin("failed", "error"), "failed")
    e = events.select("job", "seq", "stage", "percent", status.alias("to")).join(done, ["job", "seq"])
    agg = e.groupBy("job").agg(F.max(F.coalesce("percent", "done")).alias("percent"), F.max_by("to", F.when(F.col("to").isNotNull(), F.col("seq"))).alias("status"), F.max_by("stage", "seq").alias("stage"))
    return agg.select("job", F.col("percent").cast("long").alias("percent"), F.coalesce("status", F.lit("idle")).alias("status"), "stage")


@query("stream_status_override", f"with {_STAGE}, c as (select job, seq, count(*) filter (state = 'complete') * 100 // 20 as done from h group by all), j as (select e.*, c.done, case when stage = 'pipeline' and status = 'complete' then 'complete' when stage = 'pipeline' and status in ('started', 'running') then 'running' when status in ('failed', 'error') then 'failed' end as t from fx_progress e join c using (job, seq)) select job, max(coalesce(percent, done))::bigint as percent, coalesce(arg_max(t, seq) filter (t is not null), 'idle') as status, arg_max(stage, seq) as stage from j group by all")
def stream_status_override(fx_progress):
    return job_states(fx_progress)


#: Lines of a job that are kept; milliseconds of event time without a line after which a stream forgets a job; how late a line may be.
LOG_LINES, IDLE_MS, LATE = 80, 24 * 3600 * 1000, "10 minutes"
_STATE = "job long, percent long, status string, stage string, states array<string>, percents array<long>, log array<string>, error string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply_event(job: dict, stages: dict[int, tuple[str, int]], stage: str | None, status: str | None, percent: int | None) -> None:
    """One event of a job on its state, as ``stage_history`` and ``job_states`` have it for tables. ``stages`` holds those that any event has touched."""
    if stage is None:
        return
    job["stage"], at = stage, STAGE_IDS.index(stage) if stage in STAGE_IDS else -1
    for i in range(at):
        stages[i] = ("complete", 100)
    had = stages.get(at, ("pending", 0))[1]
    if at >= 0 and status == "complete":
        stages[at] = ("complete", 100)
    elif at >= 0 and status in ("started", "running"):
        stages[at] = ("running", max(had, percent or 0))
    elif at >= 0 and status in ("failed", "error"):
        stages[at] = ("failed", had)
    if stage == PIPELINE and status in ("complete", "started", "running"):
        job["status"] = "complete" if status == "complete" else "running"
    elif status in ("failed", "error"):
        job["status"] = "failed"
    done = sum(x == "complete" for x, _ in stages.values()) * 100 // len(STAGE_IDS)
    job["percent"] = max(job["percent"], done if percent is None else percent)


def _text(v):
    return None if v is None or v != v else v


class JobStates(StatefulProcessor):
    """A job's figures in one value, its stages in a map by number, and its last lines in a map by slot, a ring in which a line
    is one write however long the log: of each micro-batch only what it changes is written. A timer forgets idle jobs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "percent long, status string, stage string, error string, lines long, timer long")
        self.stages = handle.getMapState("stages", "o int", "state string, percent long")
        self.ring = handle.getMapState("ring", "slot long", "line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ("percent", "status", "stage", "error", "lines", "timer")
        job = dict(zip(names, self.job.get() if self.job.exists() else (0, "idle", None, None, 0, None)))
        stages = {int(k[0]): (v[0], int(v[1])) for k, v in self.stages.iterator()}
        before, timer, new = dict(stages), job["timer"], []
        given = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in given.itertuples(index=False):
            line, percent = _text(r.line), _text(r.percent)
            if line is not None:
                new.append(line)
                if any(w in line.lower() for w in ("error", "exception")):
                    job["error"] = line.removeprefix("Error: ")
            apply_event(job, stages, _text(r.stage), _text(r.status), None if percent is None else int(percent))
        for n, line in enumerate(new):
            if n >= len(new) - LOG_LINES:
                self.ring.updateValue(((job["lines"] + n) % LOG_LINES,), (line,))
        for o, v in stages.items():
            if before.get(o) != v:
                self.stages.updateValue((o,), v)
        job["lines"] += len(new)
        job["timer"] = max(int(given["emitted_at"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs(), (timer or IDLE_MS) - IDLE_MS) + IDLE_MS
        if job["timer"] != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(job["timer"])
        self.job.update(tuple(job[n] for n in names))
        slots = {int(k[0]): v[0] for k, v in self.ring.iterator()}
        log = [slots[n % LOG_LINES] for n in range(max(0, job["lines"] - LOG_LINES), job["lines"])]
        each = [stages.get(o, ("pending", 0)) for o in range(len(STAGE_IDS))]
        yield pd.DataFrame([[key[0], job["percent"], job["status"], job["stage"], [x for x, _ in each], [x for _, x in each], log, job["error"]]], columns=[c.split(" ")[0] for c in _STATE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.job, self.stages, self.ring):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_state_store(df: DataFrame) -> DataFrame:
    """Stateful processors keep their state in RocksDB: sets that store for the session of ``df``."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return df


def job_state_stream(lines: DataFrame) -> DataFrame:
    """The state of each job over a stream of ``job, seq, emitted_at, line`` (JSON events, errors and plain log lines), anew after every
    micro-batch with lines of it: what ``job_states``, ``stage_states`` (two arrays in the order of the stages),
    ``stream_log_ring`` and ``stream_error_extract`` say of the lines so far. Lines of a job must come in order of ``seq``,
    within a micro-batch in any. Lines later than LATE go by the watermark, and a job without
    lines for IDLE_MS of it is forgotten. Lines without progress change the log only. Sets the session's state store to RocksDB."""
    parsed = parse_lines(with_state_store(lines).withWatermark("emitted_at", LATE)).select("job", "seq", "emitted_at", "line", "stage", "status", F.col("percent").cast("double").alias("percent"))
    return parsed.groupBy("job").transformWithStateInPandas(JobStates(), _STATE, "update", "eventTime")


def job_sessions(events: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Extension: runs of a job's events at most ``gap`` apart: start, last event, events and failures. On a stream, sessions that
    a late event connects are merged until the watermark passes their end; then each is given out once (append)."""
    d = events.where("job is not null and emitted_at is not null").withWatermark("emitted_at", late)
    s = d.groupBy("job", F.session_window("emitted_at", gap).alias("w")).agg(F.count("*").alias("events"), F.count(F.when(F.col("status").isin("failed", "error"), 1)).alias("failures"), F.max("emitted_at").alias("last_at"))
    return s.select("job", F.col("w.start").alias("start_at"), "last_at", "events", "failures")


@query("ext_job_sessions", """with s as (select *, case when emitted_at - lag(emitted_at) over w >= interval 5 minutes or lag(emitted_at) over w is null then 1 else 0 end as opens from fx_progress window w as (partition by job order by emitted_at)),
r as (select *, sum(opens) over (partition by job order by emitted_at) as run from s)
select job, min(emitted_at)::timestamp as start_at, max(emitted_at)::timestamp as last_at, count(*) as events, count(*) filter (where status in ('failed', 'error')) as failures from r group by job, run""")
def ext_job_sessions(fx_progress):
    return job_sessions(fx_progress)


class TrailingMedian(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, then go out in order of time with the median of
    the last ``width`` values; the values before are kept in a list of that length."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, value double")
        self.last = handle.getListState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        at = [int(x.timestamp() * 1000) for x in given["emitted_at"]]
        self.waiting.appendList(list(zip(at, map(int, given["seq"]), map(float, given["value"]))))
        for t in sorted(set(at)):
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, now = [], expiredTimerInfo.getExpiryTimeInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(x for x in waiting if x[0] <= now)
        left = [x for x in waiting if x[0] > now]
        if not due:
            return
        values = [x[0] for x in self.last.get()] if self.last.exists() else []
        out = []
        for _, seq, value in due:
            values = [*values, value][-self.width :]
            out.append((key[0], seq, float(pd.Series(values).median())))
        self.last.put([(v,) for v in values])
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["job", "seq", "smooth"])

    def close(self) -> None:
        pass


def trailing_median_stream(events: DataFrame, width: int = 3, late: str = LATE) -> DataFrame:
    """Extension: ``job, seq, smooth`` of a stream of ``job, seq, emitted_at, value``: the median of a job's last ``width`` values in order of
    time (then ``seq``), given out once the watermark has passed a row, so out-of-order rows within ``late`` count in their place and later ones go. Sets the session's
    state store to RocksDB."""
    d = with_state_store(events).where("value is not null").withWatermark("emitted_at", late).select("job", "seq", "emitted_at", F.col("value").cast("double").alias("value"))
    return d.groupBy("job").transformWithStateInPandas(TrailingMedian(width), "job long, seq long, smooth double", "append", "eventTime")


def completions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Extension: completed stages per hour of event time; late rows go by the watermark, and a stage that is announced again
    within it counts once; a table counts every announcement."""
    done = events.where("status = 'complete'").withWatermark("emitted_at", delay)
    if events.isStreaming:
        done = done.dropDuplicatesWithinWatermark(["job", "stage", "status"])
    return done.groupBy(F.window("emitted_at", "1 hour").alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "stage", "n")


@query("ext_hourly_completions", "select date_trunc('hour', emitted_at)::timestamp as hour, stage, count(*) as n from fx_progress where status = 'complete' group by all")
def ext_hourly_completions(fx_progress):
    return completions(fx_progress)


@query("stream_log_ring", "select job, seq, line from (select *, row_number() over (partition by job order by seq desc) as n from fx_lines) t where n <= 80")
def stream_log_ring(fx_lines):
    w = Window.partitionBy("job").orderBy(F.desc("seq"))
    return fx_lines.withColumn("n", F.row_number().over(w)).where("n <= 80").select("job", "seq", "line")


_DIM = "(select unnest([" + ", ".join(f"'{s}'" for s in STAGE_IDS) + "]) as stage, unnest(range(20)) as o)"


def stage_table(jobs: DataFrame) -> DataFrame:
    """Every job with each of the twenty stages, without a join."""
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("o")) for i, s in enumerate(STAGE_IDS)])
    return jobs.select("job", F.explode(rows).alias("s")).select("job", "s.*")


@query("stream_stage_snapshot", f"with d as (select distinct job, stage from fx_progress where status in ('complete', 'skipped')) select j.job, count(d.stage) as done, (count(d.stage) * 5)::bigint as percent, min(case when d.stage is null then s.o end)::int as first_open from (select distinct job from fx_progress) j cross join {_DIM} s left join d on d.job = j.job and d.stage = s.stage group by j.job")
def stream_stage_snapshot(fx_progress):
    """Stages done, percent, and the first that isn't."""
    d = fx_progress.where("status in ('complete', 'skipped')").select("job", "stage").distinct().withColumn("d", F.lit(1))
    s = stage_table(fx_progress.select("job").distinct()).join(d, ["job", "stage"], "left")
    return s.groupBy("job").agg(F.count("d").alias("done"), (F.count("d") * 5).alias("percent"), F.min(F.when(F.col("d").isNull(), F.col("o"))).alias("first_open"))


@query("stream_restore_guard", f"with d as (select distinct job, stage from fx_progress where status in ('complete', 'skipped')), s as (select j.job, s.stage, s.o, d.stage is not null as done from (select distinct job from fx_progress) j cross join {_DIM} s left join d on d.job = j.job and d.stage = s.stage), m as (select *, min(case when not done then o end) over (partition by job) as f from s) select job, stage, case when o < coalesce(f, 99) then 'complete' when o = f then 'running' else 'pending' end as state from m")
def stream_restore_guard(fx_progress):
    """On restore, all before the first open stage is complete."""
    d = fx_progress.where("status in ('complete', 'skipped')").select("job", "stage").distinct().withColumn("d", F.lit(1))
    s = stage_table(fx_progress.select("job").distinct()).join(d, ["job", "stage"], "left")
    first = F.min(F.when(F.col("d").isNull(), F.col("o"))).over(Window.partitionBy("job"))
    return s.withColumn("f", first).select("job", "stage", F.when(F.col("o") < F.coalesce("f", F.lit(99)), "complete").when(F.col("o") == F.col("f"), "running").otherwise("pending").alias("state"))


@query("stream_error_extract", "select job, regexp_replace(arg_max(line, seq), '^Error: ', '') as error from fx_lines where regexp_matches(lower(line), 'error|exception') group by all")
def stream_error_extract(fx_lines):
    return fx_lines.where(F.lower("line").rlike("error|exception")).groupBy("job").agg(F.regexp_replace(F.max_by("line", "seq"), "^Error: ", "").alias("error"))


@query("stream_job_outcome", "select j.job, case when j.code = 0 then 'complete' else 'failed' end as outcome, case when j.code = 0 then coalesce(p.clip_count, 0) end as clips from (select job, (max(percent) % 3)::int as code from fx_progress group by all) j left join fx_projects p on p.job = j.job")
def stream_job_outcome(fx_progress, fx_projects):
    """An exit code of 0 completes a job with its clips; any other fails it."""
    j = fx_progress.groupBy("job").agg((F.max("percent") % 3).alias("code")).join(fx_projects.select("job", "clip_count"), "job", "left")
    ok = F.col("code") == 0
    return j.select("job", F.when(ok, "complete").otherwise("failed").alias("outcome"), F.when(ok, F.coalesce("clip_count", F.lit(0))).alias("clips"))
