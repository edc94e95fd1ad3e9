"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from timeloom.plans.scratch import materialise

#: Sources that targets are found for in one task: one sorted row each.
MAX_SOURCES = 1_000_000
#: Schedules by knots (training time in 0..1, weight): sources fade out, stay level or fade in.
FADING, LEVEL, RISING = ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5))


def word_count(text: Column) -> Column:
    """Number of runs without ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target, schedule_no`` from one row per source (``source, source_size``).

    Sources in code point order, nulls last, get ``weights`` in turn; together they take ``share`` times all sizes.
    Targets stop at ``most`` times their source's size and the excess is shared anew by weight until none is above:
    sorted by the level at which each source is full, the first level that its own source doesn't reach is final.
    The windows run over sources in one task, not over documents; ``mix_sources`` refuses more than MAX_SOURCES.
    """
    everything = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("schedule_no", turn).withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("schedule_no") + 1))
    s = s.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "want": F.sum("source_size").over(everything) * F.lit(float(share))})
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    spent = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.col("want") - full) / (F.sum("w").over(everything) - spent))
    final = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("w"))).select("source", "source_size", "target", "schedule_no")


def _time_at(q: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The training time by which a source has met the fraction ``q`` of its demand: the inverse of its integrated schedule."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    done, out = 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        mass = (t1 - t0) * (w0 + w1) / 2
        left = q * F.lit(total) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        # left = w0 x + slope x^2 / 2, solved without division by a slope of zero
        x = 2 * left / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0))))
        t = F.lit(t0) + F.coalesce(x, F.lit(0.0))
        done += mass
        here = q * F.lit(total) <= F.lit(done)
        out = F.when(here, t) if out is None else out.when(here, t)
    return F.least(out.otherwise(F.lit(knots[-1][0])), F.lit(1.0))


def mix_sources(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, schedules: Sequence[Sequence[tuple[float, float]]] = (FADING, LEVEL, RISING), seed: str = "mix") -> DataFrame:
    """``_row`` columns of ``docs`` (``doc_id, source, text``) with ``size, source_size, target, copies, taken, positions``.

    Each source's documents stand in the order of a hash of doc_id (then doc_id and size). Repeats of that sequence
    make up the source's stream of words; a copy is taken if its middle lies before the target, so that a source ends
    within half a document of it, and none is taken more than ``most`` times, rounded up. ``positions`` holds the training
    time of each copy: the source's cumulative demand, integrated from its schedule, inverted at the copy's middle.

    Null texts and texts of blanks have size 0 and are not taken; a null source is a source, sorted last. Repeated rows
    are separate documents; rows alike in doc_id, source and size are interchangeable. An empty table gives an empty
    one. Columns named like the results are replaced.

    The running sum over a source is taken within hash ranges and over the ranges' sums, so a source with a third of all
    rows is spread over as many tasks as there are ranges (four per shuffle partition); the ranges don't change the order.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = ["size", "source_size", "target", "copies", "taken", "positions", "_h", "_range", "_start", "_at", "_schedule"]
    h = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.drop(*extra).withColumns({"size": word_count(F.col("text")), "_h": h})
    d = d.withColumn("_range", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.lit(ranges)).cast("int"))
    sums = materialise(d.groupBy("source", "_range").agg(F.sum("size").alias("n")), "range-sizes")
    if sums.select("source").distinct().count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most).withColumnRenamed("schedule_no", "_schedule")
    starts = starts.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    starts = materialise(starts, "range-starts")
    inside = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).withColumn("_at", F.col("_at") + F.col("_start"))
    middle = lambda k: F.col("_at") + k * F.col("source_size") + F.col("size") / 2
    fits = F.filter(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)), lambda k: (middle(k) < F.col("target")) & (F.col("size") > 0))
    d = d.withColumn("_fits", fits)

    def when_taken(k: Column) -> Column:
        q = middle(k) / F.col("target")
        out = None
        for i in range(len(weights)):
            t = _time_at(q, schedules[i % len(schedules)])
            out = F.when(F.col("_schedule") == i, t) if out is None else out.when(F.col("_schedule") == i, t)
        return out

    d = d.withColumns({"positions": F.transform("_fits", when_taken), "copies": F.size("_fits")}).withColumn("taken", F.col("copies") * F.col("size"))
    return d.drop("_h", "_range", "_at", "_s", "_r", "_start", "_schedule", "_fits")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy with its ``position``, range-sorted by it (ties by doc_id)."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")


def op2_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix_sources(docs.select("doc_id", "source", "text"), (5, 2, 1))
    first = F.try_element_at("positions", F.lit(1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP2_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix' || coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 as n from s),
s2 as (select *, case n when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, source_size * 2.0::double as cap,
    (sum(source_size) over ())::double * 1.5::double as want from s1),
s3 as (select *, (want - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level from s2
    window b as (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding)),
s4 as (select *, least(cap, (select arg_min(level, cap / w) from s3 where level * w <= cap) * w) as target from s3),
p as (select d.*, s4.source_size, s4.target, s4.n,
    coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join s4 on d.source is not distinct from s4.source),
t as (select *, (before + size / 2) / target as q,
    case when size = 0 then 0 else (case when before + size / 2 < target then 1 else 0 end) + (case when before + source_size + size / 2 < target then 1 else 0 end) end as copies from p)
select doc_id, size, source_size, target, (copies * size)::bigint as taken,
  case when copies > 0 then least(1.0, 2 * q / (case n when 0 then 1.5 + sqrt(greatest(2.25 + -2.0 * q, 0.0)) when 1 then 1.0 + sqrt(greatest(1.0 + 0.0 * q, 0.0)) else 0.5 + sqrt(greatest(0.25 + 2.0 * q, 0.0)) end))::double end as first_position
from t
"""
