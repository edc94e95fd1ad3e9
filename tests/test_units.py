"""Edge rows and properties of the operators, and the stream against its batch twin."""

import datetime
import random

from pyspark.sql import functions as F

from timeloom.operators import candidates as K
from timeloom.operators import intervals as I
from timeloom.operators import windows as W
from timeloom.operators.graph import connected_components
from timeloom.operators.projections import parse_reply
from timeloom import registry
from timeloom.operators import vision as V
from timeloom.operators.vision import stabilize_short
from timeloom.sources.fixtures import fixture
from timeloom.streaming import progress as P


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_interval_kinds_across_bins(spark):
    a = frame(spark, "video_id long, k int, start_ms long, end_ms long", (1, 0, 0, 1000), (1, 1, 1000, 200_000), (2, 2, 5, 5), (1, 3, 59_999, 60_001))
    b = frame(spark, "video_id long, start_ms long, end_ms long, n int", (1, 1000, 1000, 0), (1, 999, 1001, 1), (1, 50_000, 190_000, 2), (2, 5, 5, 3), (3, 0, 9, 4))
    for kind, test in {"overlap": lambda p, q: q[1] > p[2] and q[0] < p[3], "closed": lambda p, q: q[1] >= p[2] and q[0] <= p[3], "contained": lambda p, q: q[0] >= p[2] and q[1] <= p[3], "contains": lambda p, q: q[0] <= p[2] and q[1] >= p[3]}.items():
        got = sorted((r["k"], r["n"]) for r in I.interval_join(a, I.as_right(b, n="n"), kind).collect())
        want = sorted((p["k"], q["n"]) for p in a.collect() for q in b.collect() if p["video_id"] == q["video_id"] and test((0, 0, p["start_ms"], p["end_ms"]), (q["start_ms"], q["end_ms"])))
        assert got == want, kind
    left = I.interval_join(a, I.as_right(b, n="n"), how="left")
    assert {r["k"] for r in left.collect()} == {0, 1, 2, 3}


def test_nearest_ties_to_the_earlier(spark):
    p = frame(spark, "video_id long, at_ms long", (1, 150), (1, 0), (1, 900), (2, 5))
    t = frame(spark, "video_id long, t long, n int", (1, 100, 1), (1, 200, 2))
    assert {(r["video_id"], r["at_ms"]): r["n"] for r in I.nearest(p, t, "at_ms", "t", ["n"]).collect()} == {(1, 150): 1, (1, 0): 1, (1, 900): 2, (2, 5): None}


def words(spark, *rows):
    return frame(spark, "video_id long, idx int, word string, start_ms long, end_ms long, prob_pct int, speaker string", *[(1, i, w, s, e, 90, k) for i, (w, s, e, k) in enumerate(rows)])


def test_blocks_at_the_thresholds(spark):
    got = [r["block"] for r in W.block_segmentation(words(spark, ("a", 0, 100, "A"), ("b", 1299, 1400, None), ("c", 2600, 2700, "A"), ("d", 2800, 2900, "B"))).orderBy("idx").collect()]
    assert got == [1, 1, 2, 3]  # 1,199 ms apart stays, 1,200 splits, a missing speaker is the last one's
    long = [(f"w{i}." if i in (8, 9) else f"w{i}", i * 2000, i * 2000 + 1900, "A") for i in range(12)]
    assert [r["block"] for r in W.block_segmentation(words(spark, *long)).orderBy("idx").collect()] == [1] * 9 + [2] * 3
    assert W.block_segmentation(words(spark, ("a", 0, 100, None))).count() == 1


def test_silence_and_speech_tile(spark):
    speech = frame(spark, "video_id long, start_ms long, end_ms long", (1, 100, 500), (1, 599, 700), (1, 800, 900))
    gaps = sorted((r["start_ms"], r["end_ms"]) for r in W.win_silence_complement(speech).collect())
    assert gaps == [(0, 100), (700, 800), (900, 1600)]


def test_suppression_at_the_limit(spark):
    c = frame(spark, "video_id long, cand long, start_ms long, end_ms long, score int", (1, 0, 0, 1000, 9), (1, 1, 650, 1650, 8), (1, 2, 649, 1649, 8), (1, 3, 1650, 1700, 1), (2, 0, 0, 1, 5))
    kept = {(r["video_id"], r["cand"]) for r in K.nms_overlap35(c).collect()}
    assert kept == {(1, 0), (1, 1), (1, 3), (2, 0)}  # 35 % exactly is allowed; of equal scores the earlier row wins


def test_merge_is_idempotent(spark):
    rng = random.Random(1)
    rows = [(v, i, s := rng.randint(0, 90_000), s + rng.randint(1000, 40_000), rng.randint(1, 100)) for v in range(5) for i in range(20)]
    m = K.merge_overlaps_of(frame(spark, "video_id long, cand long, start_ms long, end_ms long, score int", *rows), 60_000)
    again = K.merge_overlaps_of(m.select("video_id", "cand", "start_ms", "end_ms", "score"), 60_000)
    key = lambda d: sorted((r["video_id"], r["start_ms"], r["end_ms"]) for r in d.collect())
    for v in range(5):
        spans = sorted((a, b) for x, a, b in key(m) if x == v)
        assert all(b - a <= 60_000 for a, b in spans)
    assert len(key(again)) <= len(key(m))


def test_budget_topic_rule_needs_a_large_pool(spark):
    pool = lambda n: frame(spark, "video_id long, cand long, topic_id string, start_ms long, end_ms long, rank int", *[(1, i, "T", i * 1000, i * 1000 + 10, i + 1) for i in range(n)])
    chosen = lambda n: sum(r["selected"] for r in K.budget_select(pool(n), 2, 10_000).collect())
    assert chosen(4) == 2 and chosen(5) == 1
    one = K.budget_select(pool(3), 3, 5).collect()
    assert [r["reason"] for r in sorted(one, key=lambda r: r["rank"])] == ["selected", "duration", "duration"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(frame(spark, "src long, dst long", *edges)).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {n: find(n) for n in root}
    rng.shuffle(edges)
    assert got == {r["node"]: r["component"] for r in connected_components(frame(spark, "src long, dst long", *[(b, a) for a, b in edges])).collect()}
    assert connected_components(frame(spark, "src long, dst long")).count() == 0


def test_short_scenes_in_a_row(spark):
    d = frame(spark, "v long, i int, l int, m int", (1, 0, 7, 9000), (1, 1, 8, 100), (1, 2, 9, 200), (1, 3, 5, 8000), (2, 0, 4, 10))
    got = {(r["v"], r["i"]): r["l"] for r in stabilize_short(d, ["v"], "i", "l", "m", 1500).collect()}
    assert got == {(1, 0): 7, (1, 1): 7, (1, 2): 5, (1, 3): 5, (2, 0): 4}


def test_loose_replies(spark):
    r = frame(spark, "raw string", ("x ```json {\"start\": 1, \"end\": 2, \"score\": \"a\"}``` y",), ("none",), (None,), ("{broken",))
    assert [x["j"].asDict() if x["j"] else None for x in r.select(parse_reply(F.col("raw")).alias("j")).collect()] == [{"start": 1, "end": 2, "score": "a"}, None, None, None]


def test_stage_machine(spark):
    """A later stage completes the earlier ones; percents never fall; only the pipeline's own events run or complete the job."""
    E = "job long, seq long, stage string, status string, percent int"
    events = frame(spark, E, (1, 1, "vad", "running", 40), (1, 2, "vad", "running", 20), (1, 3, "scenes", "started", None), (1, 4, "scenes", "failed", None), (2, 1, "pipeline", "started", None), (2, 2, "audio", "skipped", None), (2, 3, "pipeline", "complete", None), (3, 1, "audio", "running", None))
    got = {(r["job"], r["stage"]): (r["state"], r["percent"]) for r in P.stage_states(events).collect()}
    assert len(got) == 60 and got[1, "audio"] == got[1, "highlights"] == ("complete", 100) and got[1, "scenes"] == ("failed", 0) and got[1, "faces"] == ("pending", 0) and got[2, "audio"] == ("pending", 0)
    jobs = {r["job"]: (r["percent"], r["status"], r["stage"]) for r in P.job_states(events).collect()}
    assert jobs == {1: (40, "failed", "scenes"), 2: (0, "complete", "pipeline"), 3: (0, "idle", "audio")}


LINES = "job long, seq long, emitted_at timestamp, line string"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows, stages = [], ["pipeline", "audio", "vad", "cut", "thumbnails", "nothing"]
    for n in range(600):
        kind = rng.random()
        line = "Error: stage lost" if kind < 0.1 else f"note {n}" if kind < 0.3 else "{broken" if kind < 0.33 else None
        if line is None:
            percent = rng.choice(["null", str(rng.randint(0, 100))])
            line = f'{{"type":"progress","stage":"{rng.choice(stages)}","status":"{rng.choice(["running", "started", "complete", "failed", "error", "skipped"])}","percent":{percent}}}'
        rows.append((rng.randint(0, 3), n, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=n), line))
    seen = []

    def keep(df, n):
        seen.extend(df.collect())

    for half in (0, 2):  # stopped and started again from its checkpoint in between
        for k in (half, half + 1):
            frame(spark, LINES, *rows[k * 150 : k * 150 + 150]).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = P.job_state_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    final = {r["job"]: r for r in seen}  # files, and so updates, in order
    lines = frame(spark, LINES, *rows)
    events = P.parse_lines(lines).where("kind = 'progress'")
    assert {(j, r["percent"], r["status"], r["stage"]) for j, r in final.items()} == {tuple(r) for r in P.job_states(events).select("job", "percent", "status", "stage").collect()}
    states = {(j, s, a, b) for j, r in final.items() for s, a, b in zip(P.STAGE_IDS, r["states"], r["percents"])}
    assert states == {tuple(r) for r in P.stage_states(events).select("job", "stage", "state", "percent").collect()}
    ring = {}
    for r in P.stream_log_ring(lines).orderBy("job", "seq").collect():
        ring.setdefault(r["job"], []).append(r["line"])
    assert {j: list(r["log"]) for j, r in final.items()} == ring and max(map(len, ring.values())) == 80
    assert {j: r["error"] for j, r in final.items()} == {r["job"]: r["error"] for r in P.stream_error_extract(lines).collect()}


def run_stream(spark, make, schema, batches, tmp_path):
    """What a stream gives of batches of rows, one file each, until the watermark has passed all but the last file."""
    out = []
    for k, rows in enumerate(batches):
        frame(spark, schema, *rows).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = make(stream).writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    return out


def test_streamed_sessions_merge(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    schema = "job long, seq long, emitted_at timestamp, status string"
    first = [(1, 1, at(0), "running"), (1, 2, at(8), "error"), (2, 3, at(1), "running"), (1, 4, at(30), "running")]
    batches = [first, [(1, 5, at(24), "running"), (1, 6, at(27), "failed"), (2, 9, at(4), "late")], [(9, 7, at(200), "running")], [(9, 8, at(400), "running")]]
    got = {(r["job"], r["start_at"]): (r["last_at"], r["events"], r["failures"]) for r in run_stream(spark, P.job_sessions, schema, batches, tmp_path)}
    on_time = [r for b in batches for r in b if r[3] != "late"]
    want = {(r["job"], r["start_at"]): (r["last_at"], r["events"], r["failures"]) for r in P.job_sessions(frame(spark, schema, *on_time)).collect() if r["start_at"] < at(400)}
    assert got == want and want[1, at(24)] == (at(30), 3, 1)  # late rows join what came before; the one beyond the watermark is gone


def test_streamed_median_in_order_of_time(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    schema = "job long, seq long, emitted_at timestamp, value double"
    rng = random.Random(8)
    values = [(j, n, at(60 * n), float(rng.randint(0, 99))) for n in range(60) for j in (1, 2)]
    shuffled = sorted(values, key=lambda r: (r[1] + rng.randint(0, 6), r[0]))
    batches = [shuffled[k : k + 30] for k in range(0, 120, 30)] + [[(3, 999, at(100_000), 1.0)], [(3, 1000, at(100_001), 2.0)]]
    got = {(r["job"], r["seq"]): r["smooth"] for r in run_stream(spark, P.trailing_median_stream, schema, batches, tmp_path)}
    want = {}
    for j in (1, 2):
        own = [r[3] for r in values if r[0] == j]
        for n in range(60):
            last = sorted(own[max(0, n - 2) : n + 1])
            want[j, n] = (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2
    assert got == want


def test_left_rows_stay(spark):
    """Equal left rows each keep their pairs, rows with nulls stay, rows over several bins come once."""
    a = frame(spark, "video_id long, k int, start_ms long, end_ms long", (1, None, 0, 100), (1, None, 0, 100), (1, 5, 500_000, 900_000), (2, 6, None, 10), (1, 7, 0, 300_000))
    b = frame(spark, "video_id long, start_ms long, end_ms long, n int", (1, 50, 60, 1), (1, 70, 200_000, 2))
    got = sorted(((r["k"], r["n"]) for r in I.interval_join(a, I.as_right(b, n="n"), how="left").collect()), key=str)
    assert got == sorted([(None, 1), (None, 2), (None, 1), (None, 2), (5, None), (6, None), (7, 1), (7, 2)], key=str)
    clips = frame(spark, "video_id long, k string, start_ms long, end_ms long", (1, None, 0, 100), (1, None, 0, 100), (3, "x", 0, 50))
    assert len(K.min_duration(clips, b, 1000, 5000).collect()) == 3


def face_tracks_by_hand(rows):
    """Frame by frame, from the surest and largest face on: each joins the best of the tracks that wait, or opens one."""
    tracks, out = [], {}
    for at in sorted({r["t_ms"] for r in rows}):
        waiting, taken = [i for i, t in enumerate(tracks) if at - t["t_ms"] <= 2000], set()
        for d in sorted((r for r in rows if r["t_ms"] == at), key=lambda r: (-r["weight"], r["event_id"])):
            best, where = 0.0, None
            for i in waiting:
                t = tracks[i]
                if i in taken:
                    continue
                iw = max(0, min(d["x"] + d["w"], t["x"] + t["w"]) - max(d["x"], t["x"]))
                ih = max(0, min(d["y"] + d["h"], t["y"] + t["h"]) - max(d["y"], t["y"]))
                far = ((d["x"] + d["w"] / 2 - t["x"] - t["w"] / 2) ** 2 + (d["y"] + d["h"] / 2 - t["y"] - t["h"] / 2) ** 2) ** 0.5 / max(1, (d["w"] + d["h"] + t["w"] + t["h"]) / 4)
                u, v = d["appearance"], t["appearance"]
                cos = sum(p * q for p, q in zip(u, v)) / (sum(p * p for p in u) * sum(q * q for q in v)) ** 0.5
                score = 0.55 * iw * ih / (d["w"] * d["h"] + t["w"] * t["h"] - iw * ih) + 0.25 * max(0, 1 - far) + 0.2 * min(1, max(0, cos))
                if score > best:
                    best, where = score, i
            if best < 0.48:
                tracks.append(d)
                where = len(tracks) - 1
            tracks[where] = d
            taken.add(where)
            out[d["event_id"]] = where
    return out


def test_face_tracks_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    f = V.faces(fixture(spark, sf, "fx_samples"), spark.read.parquet(f"{sf}/embeddings.parquet"))
    groups = {}
    for r in f.collect():
        groups.setdefault((r["video_id"], r["scene"]), []).append(r)
    got = {r["event_id"]: r["track"] for r in V.face_tracks(f).collect()}
    assert got == {e: t for rows in groups.values() for e, t in face_tracks_by_hand(rows).items()}
    spans = {(r["video_id"], r["scene"], r["track"]): (r["n"], r["start_ms"], r["end_ms"]) for r in registry.queries()["udtf_face_tracks"](spark, sf).collect()}
    assert sum(n for n, _, _ in spans.values()) == len(got) and all(a <= b for _, a, b in spans.values())


def test_lines_parse(spark):
    d = frame(spark, "line string", ('{"type":"progress","stage":"vad","status":"running","percent":3}',), ("Error: no",), ("hello",), (None,), ("{oops",))
    assert [r["kind"] for r in P.parse_lines(d).collect()] == ["progress", "error", "log", "log", "log"]
