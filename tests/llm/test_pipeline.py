"""The pipeline's stages on a small corpus with planted copies, leaks and boilerplate."""

import random
import re

import corpus_pipeline as P

from tests.llm.test_llm import make


def test_line_dedup_spares_only_copies(spark):
    rng = random.Random(2)
    common = [make(rng, 30) for _ in range(3)]
    rows = [(i, "\n".join([*rng.sample(common, 2), make(rng, 12)])) for i in range(40)]  # most of each is shared, none is a copy
    base = "\n".join(make(rng, 12) for _ in range(8))
    rows += [(100 + i, base) for i in range(12)] + [(200 + i, base.replace(base.split()[i * 3], "edited", 1)) for i in range(5)] + [(None, base)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in P.line_dedup(spark, docs, "").collect())
    assert got == sorted((i or -1, w, len(w)) for i, t in rows for w in [t if i is None or i >= 100 else t.split("\n")[-1]])


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: "\n".join(make(rng, 12) for _ in range(n))
    bench = [(i, make(rng, 30)) for i in range(5)]
    rows = [(i, text(6) + "\nShare this page", "en") for i in range(60)]
    base = text(8)
    rows += [(100 + i, base, "en") for i in range(15)]  # more than ten exact copies
    rows += [(200 + i, base.replace(base.split()[i * 3], "edited", 1), "en") for i in range(12)]
    rows += [(300 + i, text(3) + "\n" + b, "en") for i, (_, b) in enumerate(bench)]
    rows += [(400, "12345 !!!", "en"), (401, None, None)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, l, f"s{i % 3}", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, seen = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == cols, name
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    ids = [set(s) for s in seen]
    assert {400, 401}.isdisjoint(ids[0]) and ids[0] == ids[1] == {i for i, _, _ in rows} - {400, 401}
    assert all("Share this page" not in seen[1][i] for i in range(60)) and all(seen[1][100 + i] == base for i in range(15))
    assert ids[2] == set(range(60)) | {100} | {300 + i for i in range(5)}
    assert ids[3] == set(range(60)) | {100}
    mixed = P.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in mixed} <= ids[3] and [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)
    assert len(P.run(spark, d).collect()) == len(mixed)


def write(spark, d, rows, bench, ids="long"):
    spark.createDataFrame(rows, f"doc_id {ids}, text string, lang string, source string, n_chars long, title string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def stages(spark, d):
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs.collect()
    return seen, P.STAGES[-1][1](spark, docs, d).collect()


def test_rows_without_good_ids(spark, tmp_path):
    """Null, repeated and non-numeric ids, equal rows, texts of a few words, a very long one, and a column of another's name."""
    rng = random.Random(3)
    bench = [(1, make(rng, 30)), (2, make(rng, 25))]
    texts = [(None, make(rng, 40) + " " + bench[0][1]), ("x", make(rng, 20) + "\n" + bench[1][1]), ("x", make(rng, 50)), ("x", make(rng, 50)), (None, make(rng, 60)), ("b", "alpha bravo"), ("c", "a b c"), ("d", make(rng, 30_000))]
    same = ("twin", make(rng, 40))
    rows = [(i, t, "en", f"s{n % 2}", len(t), "t") for n, (i, t) in enumerate([*texts, same, same, (None, same[1]), ("", same[1])])] + [(None, None, None, None, None, None), ("e", "", "en", "s0", 0, "")]
    d = str(tmp_path)
    write(spark, d, rows, bench, "string")
    seen, mixed = stages(spark, d)
    assert len(seen["language_id"]) == len(rows) - 2
    kept = [(r["doc_id"], r["text"]) for r in seen["near_dedup"]]
    assert sorted(kept, key=str) == sorted([*texts, ("", same[1])], key=str)
    clean = [(r["doc_id"], r["text"]) for r in seen["decontamination"]]
    assert sorted(clean, key=str) == sorted([*texts[2:], ("", same[1])], key=str)
    assert {r["text"] for r in mixed} <= {t for _, t in clean} and len(mixed) > 3


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_against_brute_force(spark):
    """On the smallest given documents each stage does to its own input what a plain reading of its rule says."""
    import collections

    sf = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    words = lambda t: re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())
    for name, stage in P.STAGES[:-1]:
        before = docs.collect()
        docs = P.materialise(stage(spark, docs, sf), name)
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            assert all(r["doc_id"] in ids for r in before if r["lang"] and len(words(r["text"])) > 30) and not any(r["doc_id"] in ids for r in before if not r["text"])
        elif name == "line_dedup":
            key = lambda l: l.strip(" \t\n\x0b\x0c\r").lower() if l.isascii() else "".join(c.lower() if c < "\x80" else c for c in l.strip(" \t\n\x0b\x0c\r"))
            n = collections.Counter(k for r in before for k in {key(l) for l in (r["text"] or "").split("\n")})
            want = {r["doc_id"]: "\n".join(l for l in r["text"].split("\n") if not (key(l) and n[key(l)] >= 10)) for r in before}
            old = {r["doc_id"]: r["text"] for r in before}
            assert ids == set(old)
            for r in after:  # copies of which most would go are left to the next stage
                assert r["text"] == want[r["doc_id"]] or (r["text"] == old[r["doc_id"]] and len(want[r["doc_id"]]) < len(r["text"]) * 0.5)
        elif name == "near_dedup":
            sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in before for w in [words(r["text"])] if w}
            like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            kept = sorted(i for i in ids if i in sets)
            assert all(like(a, b) < 0.83 for k, a in enumerate(kept) for b in kept[:k] if 0.7 < len(sets[a]) / len(sets[b]) < 1.5)
            assert all(any(like(i, o) > 0.77 for o in sets if o != i) for i in sets if i not in ids)
        else:
            items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            holds = {r["doc_id"] for r in before if any(t in " ".join(words(r["text"])) for t in items)}
            assert not holds & ids


def test_copies_among_shared_lines_are_found(spark):
    """Pairs of near copies four fifths of whose lines are shared by all, and groups of edited copies: every one is known as a copy, nothing else is."""
    rng = random.Random(11)
    common = [make(rng, 14) for _ in range(60)]
    rows, copies = [], set()

    def near(a, b):
        sh = lambda t: {tuple(w[i : i + 5]) for w in [re.split(r"\W+", t)] for i in range(len(w) - 4)}
        return len(sh(a) & sh(b)) / len(sh(a) | sh(b)) >= 0.8

    for n in range(100):
        lines = [*rng.sample(common, 16), *(make(rng, 14) for _ in range(4))]
        rng.shuffle(lines)
        a = "\n".join(lines)
        words = a.split(" ")
        words[rng.randrange(len(words))] = "edited"
        b = " ".join(words)
        rows += [(2 * n, a), (2 * n + 1, b)]
        if near(a, b):
            copies |= {2 * n, 2 * n + 1}
    rows += [(1000 + n, "\n".join([*rng.sample(common, 16), *(make(rng, 14) for _ in range(4))])) for n in range(100)]
    base = [*rng.sample(common, 16), *(make(rng, 14) for _ in range(4))]
    for n in range(60):
        edit = list(base)
        edit[n % 20] = edit[n % 20].replace(" ", f" x{n} ", 1)
        rows.append((2000 + n, "\n".join(edit)))
        copies.add(2000 + n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = docs.select("doc_id", P.text_key().alias("_copy"))
    got = {r["doc_id"] for r in P.copied_texts(docs).join(keys, "_copy").collect()}
    assert len(copies) > 200 and len(got & copies) >= 0.99 * len(copies) and not got - copies
