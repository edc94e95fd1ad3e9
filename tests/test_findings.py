"""Small cases of what a review found: hooks of long texts, translated repeats, duplicates, binned joins."""

import time

import pytest
from pyspark.sql import functions as F

from timeloom import registry
from timeloom.operators import projects as P
from timeloom.sources import fixtures
from timeloom.sources.fixtures import fixture


LONG = " ".join(c * 5000 for c in "abc") + "."


def candidates(spark, rows):
    return spark.createDataFrame([(1, i, t, 0, 40_000, 50) for i, t in enumerate(rows)], "video_id long, cand long, text string, start_ms long, end_ms long, score long")


def in_seconds(df, name, most=10):
    started = time.time()
    got = {r["cand"]: r[name] for r in df.collect()}
    assert time.time() - started < most
    return got


def test_hook_is_linear_in_its_letters(spark):
    texts = [LONG, "", "Word. two. ", None, "one two three four five six seven eight nine ten, end. Don't stop me NOW5x. a b c."]
    titled = " ".join(c.upper() + c * 4999 for c in "abc") + "..."
    got = in_seconds(P.fn_hook(candidates(spark, texts)), "hook")
    assert got == {0: titled, 1: P.NO_TEXT_HOOKS[1], 2: P.NO_SENTENCE_HOOKS[2], 3: P.NO_TEXT_HOOKS[3], 4: "Don'T Stop Me Now5X..."}


def test_wrap_is_linear_in_its_letters(spark):
    got = in_seconds(P.fn_wrap(candidates(spark, [LONG, "one two three four five six seven eight nine ten"])), "wrapped")
    assert got == {0: "|".join(c.upper() + c * 4999 for c in "abc") + "...", 1: "One Two Three Four|Five Six Seven..."}


def test_stages_are_linear_in_the_letters_of_a_hook(spark):
    assert in_seconds(P.udf_stage_registry(candidates(spark, [LONG])), "hook", 20)[0].endswith("C" + "c" * 4999 + "...")


def test_translated_repeats_as_in_the_sql():
    p = P.DictionaryProvider({"de": {"the": "der"}})
    assert [p.translate(t, "de") for t in ("the the", "the the the", "the end", "at the", "", "the  the")] == ["der the", "der the der", "der end", "at der", "", "der  der"]


def test_duplicates_shuffle_numbers_and_few_pairs(spark):
    import random

    from timeloom.operators import candidates as K

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    said = [" ".join(rng.sample(vocabulary, 30)) for _ in range(12)]
    texts = [t for i in range(40) for t in (said[i % 12] + ".", "Alike start here. " + " ".join(rng.sample(vocabulary, 28)), ("same hook. " if i % 2 else "Same hook! ") + said[i % 5][: 60 + i])] + ["", "...", "x", "x"]
    rows = [(v, c, f"T{(v + c) % 2}", 1000 * c, 1000 * c + 1700 * (1 + c % 2), t) for v in (1, 2) for c, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "video_id long, cand long, topic_id string, start_ms long, end_ms long, text string")
    want = {}
    import re

    tok = lambda t: set(re.findall("[a-z0-9']+", t.lower()))
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    side = [(v, c, p, s, e, tok(t), tok(re.match("[^.?!]*[.?!]?", t)[0])) for v, c, p, s, e, t in rows]
    for a in side:
        for b in side:
            if a[0] == b[0] and a[1] < b[1]:
                cut = max(0, min(a[4], b[4]) - max(a[3], b[3]))
                iou, j = cut / max(100, a[4] - a[3] + b[4] - b[3] - cut), jac(a[5], b[5])
                comp = j * 0.40 + iou * 0.30 + (a[2] == b[2]) * 0.15 + jac(a[6], b[6]) * 0.15
                if iou >= 0.7 or j >= 0.65 or comp >= 0.5:
                    want[a[0], a[1], b[1]] = "time" if iou >= 0.7 else "vocabulary" if j >= 0.65 else "composite"
    got = K.duplicate_pairs(d).collect()
    assert {(r["video_id"], r["a"], r["b"]): r["reason"] for r in got} == want and len(got) == len(want)
    assert set(want.values()) >= {"vocabulary", "composite"}
    # of a vocabulary that all share, far fewer pairs than all are compared, and their tokens are numbers
    n = K.numbered_tokens(d)
    assert dict(n.select("tok.id").dtypes) == {"id": "array<int>"}
    assert K.pairs_to_compare(n).count() < len(want) + len(side) * 3 and K.pairs_to_compare(n).count() < len(side) * len(texts) / 4


def test_tokens_as_numbers():
    import re

    import pyarrow as pa

    from timeloom.operators.duplicates import numbered

    odd = [f"a{chr(c)}b{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)]
    texts = ["x", "Don't stop. Stop me now, don't", None, "", "...", "no end here 5", "5", "A a. A! b", "?b b", "\u0130stanbul \u212aelvin. k", *odd]
    for own, held in ((texts, pa.array(texts)), (texts[3:9], pa.array(texts).slice(3, 6)), ([], pa.array([], pa.string())), ([None], pa.array([None], pa.string()))):
        begin, ids, hook = numbered(held)
        names: dict[str, int] = {}
        for i, t in enumerate(own):
            low = (t or "").lower()
            words, first = set(re.findall("[a-z0-9']+", low)), set(re.findall("[a-z0-9']+", re.match("[^.?!]*[.?!]?", low)[0]))
            got = ids[begin[i] : begin[i + 1]].tolist()
            assert len(got) == len(set(got)) == len(words) and hook[begin[i] : begin[i + 1]].sum() == len(first)
            # a word has one number, which no other has
            assert {names.setdefault(w, n) for w, n in zip(sorted(words), got)} == set(got) if len(words) == 1 else True
        assert len(begin) == len(own) + 1 and begin[-1] == len(ids)


def linked_by_hand(rows):
    """``(video_id, cand): component`` of the rule over all pairs."""
    import re

    tok = lambda t: set(re.findall("[a-z0-9']+", (t or "").lower()))
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    side = [(v, c, p, s, e, tok(t), tok(re.match("[^.?!]*[.?!]?", t or "")[0])) for v, c, p, s, e, t in rows if None not in (v, c)]
    root = {r[:2]: r[:2] for r in side}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for a in side:
        for b in side:
            if a[0] == b[0] and a[1] < b[1]:
                timed, iou, j = None not in (*a[3:5], *b[3:5]), 0.0, jac(a[5], b[5])
                if timed:
                    cut = max(0, min(a[4], b[4]) - max(a[3], b[3]))
                    iou = cut / max(100, a[4] - a[3] + b[4] - b[3] - cut)
                comp = j * 0.40 + iou * 0.30 + (a[2] == b[2]) * 0.15 + jac(a[6], b[6]) * 0.15
                if iou >= 0.7 or j >= 0.65 or comp >= 0.5 and timed and None not in (a[2], b[2]):
                    x, y = sorted((find(a[:2]), find(b[:2])))
                    root[y] = x
                    linked |= {a[:2], b[:2]}
    return {k: find(k)[1] for k in linked}


def said_rows():
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)]
    said = [" ".join(rng.sample(vocabulary, 30)) for _ in range(9)]
    rows = []
    for v, n in ((1, 150), (2, 40), (3, 1), (4, 2), (-5, 9), (None, 6), (6, 30)):
        for c in range(n):
            kind = rng.randint(0, 5)
            own = rng.sample(vocabulary, 28)
            other = said[rng.randint(0, 8)].split()
            text = ["Alike start here. " + " ".join(own), " ".join(other[: rng.randint(15, 30)] + own[:5]) + ".", ("same hook. " if c % 2 else "Same Hook! ") + " ".join(other[:17] + own[:7]), " ".join(own), None if c % 2 else "...", "x"][kind]
            rows.append((v, c, f"T{(c + kind) % 3}" if c % 10 else None, 1000 * c, 1000 * c + rng.choice((900, 1700, 4000)), text))
    return [*rows, *[r for r in rows if r[0] == 6], (1, None, "T1", 0, 900, "x"), (1, 500, "T1", None, 900, "x"), (2, 600, "T1", 0, None, "x")]


LINKS = "video_id long, cand long, topic_id string, start_ms long, end_ms long, text string"


@pytest.mark.parametrize("rows, size, late", [(8192, 32_000_000, 0), (39, 32_000_000, 5), (8192, 3000, 5)])
def test_components_in_the_task_of_a_video(spark, monkeypatch, rows, size, late):
    from timeloom.operators import candidates as K, duplicates as D

    table = said_rows()
    if late:  # joins number rows of a candidate that comes twice together, and tell by times whether two share time
        table = [r for i, r in enumerate(table) if r not in table[:i] and None not in r[3:5]]
        monkeypatch.setattr(D, "MAX_ROWS", rows)
        monkeypatch.setattr(D, "MAX_BYTES", size)
    else:  # rounds over written tables aren't needed
        monkeypatch.setattr(K, "connected_components", None)
    monkeypatch.setattr(D, "BLOCK", 16)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.createDataFrame(table, LINKS)
        want = linked_by_hand(table)
        got = K.linked(d).collect()
        assert sorted(map(str, ((r["video_id"], r["cand"], r["start_ms"], r["component"]) for r in got))) == sorted(map(str, ((r[0], r[1], r[3], want.get(r[:2])) for r in table)))
        assert bool(late) == (not D.linked_in_tasks(d).where("late").isEmpty()) and len(set(want.values())) > 4
        c = K.graph_components(d).collect()
        assert {(r["video_id"], r["node"]): r["component"] for r in c} == want and len(c) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def plan_of(df, capsys):
    """The physical plan as text; what has run before (written tables) isn't in it."""
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def made_from_documents(df, capsys):
    """How often other rows than texts are shuffled, and how often all their words are made, in what is still to run."""
    plan = plan_of(df, capsys)
    return len([x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "(doc_id#" not in x]), plan.count("posexplode(")


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["agg_text_between", "ext_session_words", "win_block_segmentation", "snk_captions", "agg_region_confidence", "fn_description"])
def test_words_are_not_shuffled(spark, capsys, name):
    # captions are written, so their source is looked at
    shuffles, words = made_from_documents(fixture(spark, SF, "fx_segments") if name == "snk_captions" else registry.queries()[name](spark, SF), capsys)
    assert shuffles == 0 < words <= 2


def test_parts_of_texts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "PART_BYTES", 10_000)
    assert fixture(spark, SF, "fx_words").rdd.getNumPartitions() > 20


def test_candidates_make_segments_once(spark, capsys):
    assert made_from_documents(fixture(spark, SF, "fx_candidates"), capsys) == (0, 1)


@pytest.mark.parametrize("name", ["gen_segment_windows", "score_candidate", "topk_highlights"])
def test_windows_make_words_once(spark, capsys, name):
    assert made_from_documents(registry.queries()[name](spark, SF), capsys) == (0, 1)


@pytest.mark.parametrize("name, most", [("join_snap_speech", 0), ("agg_quality_grade", 1), ("join_clip_results", 2), ("join_scene_clip", 1)])
def test_what_is_read_twice_is_written(spark, capsys, name, most):
    assert made_from_documents(registry.queries()[name](spark, SF), capsys)[1] <= most


def test_windows_of_long_and_nested_segments(spark):
    from timeloom.operators import candidates as K

    rows = [(1, 0, 0, 90_000, "why a?", 2), (1, 1, 10_000, 20_000, "b.", 1), (1, 2, 70_000, 80_000, "c.", 1), (1, 3, 90_000, 125_000, "d.", 1), (2, 0, 0, 25_000, "e", 1), (2, 1, 25_000, 60_000, None, 0)]
    s = spark.createDataFrame(rows, "video_id long, seg_idx int, start_ms long, end_ms long, text string, word_count long")
    got = {(r["video_id"], r["first_seg"], r["last_seg"], r["marked"], r["video_ms"]) for r in K.segment_windows(s, 20_000, 60_000).collect()}
    assert got == {(1, 0, 0, True, 125_000), (1, 0, 1, True, 125_000), (1, 2, 3, False, 125_000), (1, 3, 3, False, 125_000), (2, 0, 0, False, 60_000), (2, 0, 1, False, 60_000), (2, 1, 1, None, 60_000)}


def test_tags_search_a_text_once(spark, capsys):
    d = spark.createDataFrame([(1, "Word word other OTHER abc more", "en")], "doc_id long, text string, lang string")
    tags = P.set_tag_union(d)
    assert plan_of(tags, capsys).count("regexp_extract_all(") == 1
    assert tags.first()["tags"] == "#Clip #en #Word #other #more"


def test_far_faces_need_no_appearance(spark, capsys):
    """a pair that can't match isn't compared by its appearance, and the table function gives times itself, so that faces aren't made twice."""
    from timeloom.operators import vision

    far = [{"x": x, "y": 0, "w": 20, "h": 20, "t_ms": 0} for x in (0, 1000)]
    assert vision.match_score(*far) < vision.LEAST_MATCH - vision.MATCH[2]
    registry.queries()["udtf_face_tracks"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("events.parquet") == 1


def refined_by_hand(moves, clip, rounds=3):
    """What a clip's ends become: ``moves`` are of starts and of ends, by time ``(to, confidence)``."""
    s, e, done, n, conf = *clip, False, 0, 0.0
    for k in range(rounds):
        (s_to, cs), (e_to, ce) = moves[0].get(s, (s, 0.5)), moves[1].get(e, (e, 0.5))
        now = cs * 0.45 + ce * 0.55
        done = done or now >= 0.85 or (k > 1 and now - conf < 0.02)
        s, e, n, conf = (s, e, n, now) if done else (s_to, e_to, n + 1, now)
    return s, e, done, n, round(conf, 9)


def test_boundaries_move_as_by_hand(spark):
    """a word knows the moves of the words that it moves to."""
    import random

    from timeloom.operators import editorial as E

    rng, rows, clips, want = random.Random(5), [], [], {}
    for v in range(1, 9):
        t = 0
        for i in range(60):
            long = rng.choice([100, 300, 700])
            rows.append((v, i, rng.choice(["and", "They", "so.", "it?", "word", "other", "end.", "..."]), t, t + long, rng.choice([40, 90])))
            t += long + rng.choice([1, 50, 450, 600, 1500])
        for k in range(40):
            a, z = sorted(rng.sample(range(60), 2))
            clips.append((v, k % 39, rows[-60 + a][3] + (k % 7 == 0), rows[-60 + z][4] + (k % 5 == 0)))
    clips += [(None, 1, 0, 100), (1, 77, None, None), (99, 1, 0, 100)]
    words = spark.createDataFrame(rows, "video_id long, idx int, word string, start_ms long, end_ms long, prob_pct int")
    r = E.refine_ends(words).withColumns({"cs": E.start_confidence(False), "ce": E.end_confidence(False)}).collect()
    moves = {v: ({x["start_ms"]: (x["start_to"], x["cs"]) for x in r if x["video_id"] == v}, {x["end_ms"]: (x["end_to"], x["ce"]) for x in r if x["video_id"] == v}) for v in range(1, 9)}
    assert len({x["start_to"] - x["start_ms"] for x in r}) > 20 and len({x["end_to"] - x["end_ms"] for x in r}) > 20
    got = E.refine_boundaries(spark.createDataFrame(clips, "video_id long, clip long, start_ms long, end_ms long"), words).collect()
    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(((x["video_id"], x["clip"], x["start_ms"], x["end_ms"], x["s"], x["e"], x["done"], x["rounds"], round(x["conf"], 9)) for x in got), key=key) == sorted((c + refined_by_hand(moves.get(c[0], ({}, {})), c[2:]) for c in clips), key=key)
    assert {x["rounds"] for x in got} == {0, 1, 2, 3}


def test_boundaries_of_clips_write_no_words(spark, monkeypatch):
    """starts and ends of all words were written and shuffled in each of three rounds."""
    from timeloom.operators import editorial as E

    written, write = [], E.materialise
    monkeypatch.setattr(E, "materialise", lambda df, label: (written.append(write(df, label)), written[-1])[1])
    registry.queries()["gen_boundary_refine"](spark, SF)
    assert max(t.count() for t in written) <= fixture(spark, SF, "fx_clips").count()


def test_parts_of_texts_are_small(spark):
    """F25 to F28: parts of 16 MB of files were sorted with spills."""
    assert fixture(spark, "/root/testdata/sf0.1", "fx_words").rdd.getNumPartitions() >= 8


def test_clip_quality_shuffles_no_words(spark, capsys):
    """all words were united with the clips and shuffled, for starts and again for ends."""
    assert made_from_documents(registry.queries()["score_clip_quality"](spark, SF), capsys)[0] == 0


def test_last_words_of_clips_by_hand(spark):
    from timeloom.operators import candidates as K

    words = [(1, 0, "a.", 0, 100), (1, 1, "b,", 100, 100), (1, 2, "c", 100, 400), (1, 3, "d.", 59_000, 59_900), (1, 4, "e,", 400_000, 401_000), (2, 0, "f.", 5_000, 6_000), (3, 0, "g", None, None)]
    clips = [(v, a, a + ms) for v in (1, 2, 3, 4, None) for a in (-5, 0, 1, 100, 101, 400, 59_000, 59_001, 60_000, 399_999, 400_000, 400_001, 10**9) for ms in (0, 99, 100, 300, 900, 999, 1_000, 59_900)] + [(1, None, None), (1, 101, 500), (1, 101, 500)]
    w = spark.createDataFrame(words, "video_id long, idx int, word string, start_ms long, end_ms long")
    got = K.clip_quality(spark.createDataFrame(clips, "video_id long, start_ms long, end_ms long"), w, 5000, 20_000, F.lit(50)).collect()

    def by_hand(v, a, z):
        own = [] if a is None else [x for x in words if x[0] == v and x[3] is not None]
        prev, last = ([x for x in own if x[3] < a] or [None])[-1], ([x for x in own if x[4] <= z] or [None])[-1]
        how = 10 if a is not None and a <= 200 or prev and prev[2][-1] == "." else 5 if prev and a - prev[4] > 1000 else 0
        return 50 + how + (0 if not last else 15 if last[2][-1] == "." else 5 if last[2][-1] == "," else 0) + (25 if a is not None and 5000 <= z - a <= 20_000 else -15)

    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(((r["video_id"], r["start_ms"], r["end_ms"], r["quality"]) for r in got), key=key) == sorted(((*c, by_hand(*c)) for c in clips), key=key)


def test_captions_are_written_where_they_are(spark, monkeypatch, capsys):
    """cues were shuffled again, into 32 shares however many there were."""
    from timeloom.plans import scratch

    written = []
    monkeypatch.setattr(P, "written_text", lambda df, label, by: (written.append(df), scratch.written_text(df, label, by))[1])
    lines = registry.queries()["snk_captions"](spark, SF)
    assert made_from_documents(written[0], capsys)[0] == 0
    where = lines.withColumn("f", F.input_file_name()).groupBy("video_id").agg(F.count_distinct("f").alias("n"))
    assert where.where("n > 1").count() == 0 < where.count()
    assert lines.select(F.input_file_name()).distinct().count() == fixture(spark, SF, "fx_words").rdd.getNumPartitions()
    times = {}
    for r in lines.collect():
        times.setdefault(r["video_id"], []).append(r["start_ms"])
    assert all(t == sorted(t) for t in times.values())


@pytest.mark.parametrize("name", ["agg_cluster_summary", "graph_dedupe"])
def test_candidates_are_read_once_for_their_clusters(spark, capsys, name):
    # what is left to run reads what was written, no words
    assert made_from_documents(registry.queries()[name](spark, SF), capsys)[1] == 0


def test_dedupe_writes_what_it_needs(spark, monkeypatch):
    from timeloom.operators import candidates as K

    seen = []
    monkeypatch.setattr(K, "linked", lambda d: (seen.append(d.columns), d.drop("text").withColumn("component", F.lit(None).cast("long")))[1])
    registry.queries()["graph_dedupe"](spark, SF)
    assert seen == [[*K._LINKS, "score"]]
