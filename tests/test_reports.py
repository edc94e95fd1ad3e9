"""Composition reports, zone picks, peak sub-candidates and medians of large groups against plain loops and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators.aggregates import composition_report, fit_guard, selected_median, weighted_median
from timeloom.operators.candidates import zone_picks
from timeloom.operators.editorial import peak_subcandidates
from timeloom.operators.projections import aliased

BOX = "clip long, x double, y double, w double, h double"
CROP = "clip long, cx double, cy double, cw double, ch double, width int, height int, duration_ms long"


def report(spark, subjects, faces, crops=((1, 500.0, 0.0, 608.0, 1080.0, 1920, 1080, 1500),)):
    r = composition_report(spark.createDataFrame(list(crops), CROP), spark.createDataFrame(subjects, BOX), spark.createDataFrame(faces, BOX), ["clip"])
    return r, r.collect()[0]


def test_report_of_a_good_crop(spark):
    r, row = report(spark, [(1, 700.0, 100.0, 200.0, 900.0)] * 4, [(1, 750.0, 150.0, 100.0, 120.0)] * 4)
    assert (row.status, row.reasons, row.quality_index, row.coverage, row.min_containment) == ("pass", [], 1.0, 1.0, 1.0)
    assert fit_guard(r, ["clip"]).collect()[0].forced is False


def test_faces_decide_where_measured(spark):
    clipped = [(1, 300.0, 100.0, 300.0, 900.0)] * 4
    r, row = report(spark, clipped, [(1, 750.0, 150.0, 100.0, 120.0)] * 4)
    assert row.status == "warning" and row.reasons == ["selected_subject_materially_clipped", "selected_subject_near_horizontal_edge"]
    assert fit_guard(r, ["clip"]).collect()[0].forced is False
    r, row = report(spark, clipped, [])
    assert row.status == "fail" and row.face_coverage is None and fit_guard(r, ["clip"]).collect()[0].reasons == ["selected_subject_materially_clipped"]
    _, row = report(spark, clipped, [(1, 750.0, 10.0, 100.0, 120.0)] * 4)
    assert row.status == "fail" and row.reasons[-1] == "forehead_headroom_unsafe"


def test_report_of_poor_rows(spark):
    _, row = report(spark, [(1, None, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0)], [], [(1, 1500.0, 0.0, 608.0, 1080.0, 1920, 1080, None)])
    assert row.status == "fail" and row.quality_index == 0.0 and row.min_containment is None
    assert row.reasons == ["crop_outside_source_bounds", "no_selected_subject_detections", "selected_subject_missing_for_most_of_clip"]


def picks_by_hand(cands, limit=5):
    zone = 300_000 if max(c[3] for c in cands) >= 600_000 else 120_000
    kept = []

    def free(c):
        return all(min(c[3], k[3]) - max(c[2], k[2]) <= min(c[3] - c[2], k[3] - k[2]) * 0.35 for k in kept)

    ranked = sorted(cands, key=lambda c: (-c[4], c[1]))
    for z in sorted({c[2] // zone for c in cands}):
        kept += [c for c in ranked if c[2] // zone == z and free(c)][:1] if len(kept) < limit else []
    covered = len(kept)
    for c in ranked:
        if len(kept) < limit and free(c):
            kept.append(c)
    return [(c[0], i, c[1], c[2] // zone, i >= covered) for i, c in enumerate(kept)]


def test_zone_picks_equal_a_loop(spark):
    rng, rows = random.Random(7), []
    for video in range(30):
        span = rng.choice([100_000, 400_000, 900_000])
        for cand in range(rng.randint(1, 40)):
            start = rng.randrange(span)
            rows.append((video, cand, start, start + rng.randint(5_000, 60_000), rng.randint(1, 9)))
    got = sorted(map(tuple, zone_picks(spark.createDataFrame(rows, "video_id long, cand long, start_ms long, end_ms long, score int")).collect()))
    assert got == sorted(r for v in range(30) for r in picks_by_hand([x for x in rows if x[0] == v])) and any(r[4] for r in got)
    none = spark.createDataFrame([(1, 1, None, 5, 1)], "video_id long, cand long, start_ms long, end_ms long, score int")
    assert zone_picks(none).collect() == []


@pytest.fixture(scope="module")
def talk(spark):
    """Sentences of 12 words of 400 ms, one every 5 s, over three minutes."""
    words = [(1, s * 12 + i, f"w{i}" + ("." if i == 11 else ""), s * 5000 + i * 400, s * 5000 + i * 400 + 380) for s in range(36) for i in range(12)]
    return spark.createDataFrame(words, "video_id long, idx long, word string, start_ms long, end_ms long")


def blocks(spark, peaks):
    rows = [(1, 0, 179_800, 0.1, 0.1, 0.0, "answer")] + [(1, at, at + 1000, p, 0.9, 0.5, "story") for at, p in peaks]
    return spark.createDataFrame(rows, "video_id long, start_ms long, end_ms long, peak double, importance double, emotion double, role string")


def test_subcandidates_lead_from_the_best_peak(spark, talk):
    got = peak_subcandidates(blocks(spark, [(61_000, 0.6), (71_000, 0.9), (150_000, 0.7)]), talk).collect()
    # 71 s - 18 s = 53 s: sentence from 50 s; 50 s + 40 s = 90 s: the sentence that begins there
    assert [(r.cand, r.start_ms, r.end_ms, r.completeness) for r in got] == [(0, 50_000, 94_780, 1.0), (1, 130_000, 174_780, 1.0)]


def test_subcandidates_need_length_sentence_and_talk(spark, talk):
    short = blocks(spark, [(61_000, 0.9)]).withColumn("end_ms", F.least("end_ms", F.lit(80_000)))
    assert peak_subcandidates(short, talk).collect() == []
    # near the end of the talk less than 20 s are left
    assert peak_subcandidates(blocks(spark, [(178_500, 0.9)]), talk.where("start_ms < 175000")).where("end_ms - start_ms < 20000").collect() == []
    assert peak_subcandidates(blocks(spark, [(61_000, 0.9)]), talk.limit(0)).collect() == []
    assert peak_subcandidates(blocks(spark, []), talk).collect() == []


def test_medians_by_narrowing_equal_sorted_ones(spark):
    rng, rows = random.Random(5), []
    for i in range(6000):
        rows.append((1, rng.expovariate(1e-3) ** 3, rng.randint(0, 5)))
        rows.append((2 + i % 50, float(rng.randint(-5, 5)), 1))
    rows += [(1, 7.0, 30_000)] if rng.random() < 0.5 else [(1, -1e300, 3), (1, 1e300, 3)]
    rows += [(99, None, 1), (98, 3.0, 0), (98, 2.0, 0), (97, 1.0, None), (None, 4.0, 1), (2, 1e9, 1)]
    d = spark.createDataFrame(rows, "g int, v double, w int")
    got = dict(map(tuple, selected_median(d.where("g is not null"), ["g"], "v", "w", bins=8, small=20).collect()))
    want = dict(map(tuple, weighted_median(d.where("g is not null and v is not null and w is not null"), ["g"], "v", "w").collect()))
    assert got == want and 99 not in got and got[98] == 2.0


def test_median_of_one_group_with_all_rows(spark):
    d = spark.range(400_000, numPartitions=8).selectExpr("1 as g", "pow(id * 7919 % 400000, 2) as v", "id % 3 as w")
    assert selected_median(d, ["g"], "v", "w", small=100).collect() == weighted_median(d, ["g"], "v", "w").collect()


def test_aliases_of_drifting_artifacts(spark):
    raw = ['{"a": 1}', '{"b": {"c": [5, 6]}}', '{"a": "x", "b": {"c": [7]}}', '{"a": 1.0}', "{broken", "", None, "[1]", '{"a": null}', '{"a": "12", "z": {}}']
    d = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = {r.id: (r.v, r.w) for r in d.select("id", aliased(F.col("raw"), "bigint", "$.a", "$.b.c[0]").alias("v"), aliased(F.col("raw"), "bigint", "$.a", default=F.lit(9)).alias("w")).collect()}
    assert got == {0: (1, 1), 1: (5, 9), 2: (7, 9), 3: (1, 1), 4: (None, 9), 5: (None, 9), 6: (None, 9), 7: (None, 9), 8: (None, 9), 9: (12, 12)}
