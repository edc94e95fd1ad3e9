"""The operations of timeloom.llm against brute force and hand-made rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import decontamination, html_extract, language_id, license_scan, line_dedup, mixing, near_dedup, token_counts, url_filters, vector_search
from timeloom.llm.words import shingles, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def make(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "clash") for i, t, s in rows], DOCS)


# op1
RULES = url_filters.RULES


def test_urls_rules_and_aliases(spark):
    page = lambda head: f"<html><head>{head}</head></html>"
    rows = [
        (1, "https://a.example.org/x", page('<link rel="canonical" href="https://bad.example.net/de/y">'), "h"),
        (2, "http://bad.example.net/de/y#top", page(""), "h"),
        (3, "https://b.example.org/en/z", page('<meta http-equiv="refresh" content="0; url=//a.example.org/x">'), "h"),
        (4, "https://c.example.org/fr/ok", page('<link href="https://a.example.org/x" rel=canonical>'), "h"),
        (5, "https://X.EXAMPLE.NET/en/q?x=1", page(""), "h"),
        (6, None, None, "h"), (7, "no address", "", "h"), (8, "http://net", page(""), "h"), (9, "http://a.net/", None, "h"), (9, "http://a.net/", None, "h"),
        (10, "http://lone.example.com/de/1", page(""), "h"),
        (11, "https://d.example.org/p/q", page('<link rel="canonical" href="r">'), "h"), (12, "https://d.example.org/p/r", page('<link rel="canonical" href="http://w.example.com/de/">'), "h"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(pages.drop("html"), url_filters.alias_edges(pages), RULES).collect()}
    v = {k: r["verdict"] for k, r in got.items()}
    assert (got[5]["host"], got[5]["path"], got[5]["rule"], v[5]) == ("x.example.net", "/en/q", "example.net/en/", "allow")
    assert (got[6]["host"], got[6]["path"], got[6]["rule"], v[6]) == ("", "", None, "allow") and v[7] == "allow"
    assert got[8]["rule"] is None and got[9]["rule"] == "net/" and v[9] == "block" and v[10] == "block"
    # 1, 2, 3 and 4 are aliases: 2 is blocked by rule, 4 allowed by rule, which takes precedence for 1 and 3
    assert (v[2], v[4], v[1], v[3]) == ("block", "allow", "allow", "allow")
    assert v[11] == "block" and v[12] == "block"  # the block of the target passes over a chain of two links
    assert len(url_filters.judge_urls(pages.drop("html"), url_filters.alias_edges(pages), RULES).collect()) == len(rows)


def test_alias_targets(spark):
    link = lambda href, base="": f'{base}<link rel="canonical" href="{href}">'
    cases = [
        (link("../c?x=1&amp;y=2"), "h.org/a/c?x=1&y=2"), (link("?p=2"), "h.org/a/b/page?p=2"), (link("./d/./e/.."), "h.org/a/b/d/"), (link("http://H.org:80"), "h.org/"), (link("https://h.org:8080/#f"), "h.org:8080/"),
        (link("x", '<base href="//other.net/q/r">'), "other.net/q/x"), (link("/y", '<base href="/z/">'), "h.org/y"), (link("#top"), None), (link("mailto:me@h.org"), None), (link("../../../up"), "h.org/up"),
        ("<!-- " + link("/no") + " -->", None), ("<script>var s = '" + link("/no").replace("'", "") + "'</script>", None), ("<meta content='5; URL=\"/re\"' HTTP-EQUIV=Refresh>", "h.org/re"), ("<link rel='next canonical' href=/n>", "h.org/n"),
        ("<link rel=canonicals href=/no>", None), ("<meta http-equiv=refresh content=30>", None), (link("go?u=http://z.com/"), "h.org/a/b/go?u=http://z.com/"), ("<link data-rel=canonical href=/no>", None),
    ]
    rows = [(f"http://h.org/a/b/page?n={i}", h) for i, (h, _) in enumerate(cases)]
    got = {r["src"]: r["dst"] for r in url_filters.alias_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {f"h.org/a/b/page?n={i}": to for i, (_, to) in enumerate(cases) if to}


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge_urls(pages, url_filters.alias_edges(pages), RULES).count() == 0


# op2
def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        rest = want - sum(target[s] for s in names if s not in open_)
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        for s in open_:
            target[s] = level * w[s]
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over
    return target


def test_mixing_targets_and_order(spark):
    rng = random.Random(1)
    rows = [(i, make(rng, rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    rows += [(None, "one two", "b"), (5, None, "a"), (5, None, "a"), (6, "", None), (7, "x " * 3000, "d")]
    mixed = mixing.mix_sources(docs_frame(spark, rows), (5, 2, 1))
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    order = [r["position"] for r in mixing.training_order(mixed).select("position").collect()]
    assert order == sorted(order) and len(order) == sum(r["copies"] for r in got)
    again = mixing.mix_sources(docs_frame(spark, rows), (5, 2, 1)).select("doc_id", "taken", "positions").collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed.select("doc_id", "taken", "positions").collect()))


def test_mixing_empty(spark):
    assert mixing.mix_sources(docs_frame(spark, []), (5, 2, 1)).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(docs_frame(spark, [(1, None, "a"), (2, " ", None)]), (5,)).collect()] == [0, 0]


# op3
def test_language(spark):
    rng = random.Random(2)
    voc = {"aa": ["kalo", "mirana", "toku", "sela"], "bb": ["strumpf", "gescht", "werch", "blau"]}
    word = lambda l: "".join(rng.choice(voc[l]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(l) for _ in range(rng.randint(4, 60))), l) for i, l in enumerate(rng.choice(["aa", "aa", "bb"]) for _ in range(300))]
    edge = [(1000, None, None), (1001, "", "aa"), (1002, "123 !!!", "bb"), (1003, rows[0][1] + " " * 50_000, None), (1003, rows[0][1] * 400, None)]
    docs = spark.createDataFrame(rows[:200] + edge, "doc_id long, text string, lang string")
    made = language_id.make_dictionaries(language_id.training_sample(docs))
    assert list(made) == ["aa", "bb"]
    test = spark.createDataFrame([(i, t, "score") for i, t, _ in rows[200:]] + [(i, t, None) for i, t, _ in edge], "doc_id long, text string, score string")
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in language_id.identify(test, made).collect()]
    truth = {i: l for i, _, l in rows}
    assert sum(p == truth[i] for i, p, _, _ in got if i < 1000) >= 97
    assert all(0 <= s <= 1 for _, _, s, _ in got)
    assert [(p, s, x) for i, p, s, x in got if 1000 <= i <= 1002] == [("und", 0.0, True)] * 3
    assert {p for i, p, _, _ in got if i == 1003} == {rows[0][2]}
    signs = language_id.identify(spark.createDataFrame([("\u00b2\u00b3 \u00bd",), ("\u2163 \u0301 _ 7",), ("a\u00b2",)], "text string"), made).collect()
    assert [r["lang_pred"] == "und" for r in signs] == [True, True, False] and language_id.letters("\u0928\u092e\u0938\u094d\u0924\u0947") == "\u0928\u092e\u0938\u094d\u0924\u0947"
    none = language_id.make_dictionaries(language_id.training_sample(docs.limit(0)))
    assert none == {} and {r["lang_pred"] for r in language_id.identify(test, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    """On the given documents: of those that no dictionary has seen, nearly all are told."""
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in language_id.op3_zstd_language(spark, sf).collect() if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(got) > 150 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in got) >= 0.97 * len(got)


# op4
def test_vector_search(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:160] = v[100]
    rows = [(int(i), [float(x) for x in e]) for i, e in enumerate(v)]
    odd = [(2000, None), (2001, [0.0] * 8), (2020, [float("nan")] * 8), (2040, [1.0, None] + [1.0] * 6), (None, [1.0] * 8), (2060, [1.0] * 3), (2080, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in vector_search.search(df, F.col("vec_id") % 20 == 0, 20, share=0.8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {*range(0, 1500, 20), 2060}
    ids = np.array([*range(1500), 2060])  # the short vector counts as if it ended in zeros
    e, hits = np.vstack([v, [[1.0] * 3 + [0.0] * 5]]).astype(np.float64), 0
    for q, found in got.items():
        s = e @ e[ids.searchsorted(q)]
        want = [ids[i] for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:20]
        mine = [found[k][0] for k in sorted(found)]
        assert len(mine) == 20 and q not in mine and [found[k][1] for k in sorted(found)] == sorted((x for _, x in found.values()), reverse=True)
        assert all(x == pytest.approx(float(s[ids.searchsorted(i)]), abs=1e-12) for i, x in found.values())
        hits += len(set(mine) & set(want))
    assert hits / (20 * len(got)) >= 0.9
    assert [got[100][k][0] for k in range(1, 7) if got[100][k][0] != 2060][:5] == [101, 102, 103, 104, 105]  # equal vectors: smaller ids first
    few = vector_search.search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2 and vector_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_traversal_covers_the_nearest_cells():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.standard_normal(rng.integers(1, 40)), rng.standard_normal(rng.integers(1, 40))
        if rng.random() < 0.3:
            a[:], b[:] = np.round(a), np.round(b)  # many equal sums
        counts = rng.integers(0, 4, (len(a), len(b)))
        order = np.sort(-(a[:, None] + b[None]), axis=None)
        for wanted in (1, int(counts.sum() * 0.5), int(counts.sum() * 0.97), int(counts.sum()) + 5):
            least = vector_search.traverse(a, b, counts, wanted)
            sums = a[:, None] + b[None]
            inside = counts[sums >= least].sum()
            assert inside >= min(wanted, counts.sum()) and counts[sums > least].sum() < max(1, wanted) and (-least == order).any()
    started = __import__("time").time()
    vector_search.traverse(rng.standard_normal(1024), rng.standard_normal(1024), np.ones((1024, 1024), np.int64), 700_000)
    assert __import__("time").time() - started < 1.5  # by the heap alone it takes several seconds


# op5
def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    bits = ["the", " ", "  ", "\n", "\t", "\r\n", "▁", "é", "日本", "🙂", "<s>", "</s>", "ing", "a", ".", "x" * 300, "1999", " ", "'s"]
    texts = [None, "", " ", "\n\n", " \n ", "the " * 5000] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in token_counts.with_token_counts(df, path, 4096).collect():
        t = texts[r["doc_id"]] or ""
        n = len(model.encode(t))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 4096), repr(t)
    assert token_counts.with_token_counts(df.limit(0), path).count() == 0


# op6
def test_licenses(spark):
    texts = {
        1: "Some words.\nReleased under the MIT License.\nMore", 2: "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", 3: None, 4: "", 5: "the license of nothing",
        6: "Licensed under CC BY-NC 4.0.\n" + "x " * 20000 + "\nThis work is licensed under the GNU General Public License, version 3.", 7: "  LICENSED under the   MIT license!  ",
    }
    df = spark.createDataFrame([(k, t, "c") for k, t in texts.items()] + [(1, texts[1], "c")], "doc_id long, text string, license string")
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: ("MIT", ["MIT"]), 2: ("Apache", ["Apache"]), 3: (None, []), 4: (None, []), 5: (None, []), 6: ("GPL", ["GPL", "CC-BY-NC"]), 7: ("MIT", ["MIT"])}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    seq = license_scan.scan_licenses(df, {"a": "1", "b": "2", "license": "3"}, [("X", ("1", "2")), ("Y", ("2", "1"))])
    assert {r["license"] for r in seq.collect()} == {None}
    own = license_scan.scan_licenses(spark.createDataFrame([("Alpha beta\ngamma.",), ("alpha beta gamma delta",), ("7",)], "text string"), {"alpha beta gamma": "x", "#": "y"}, [("X", ("x",)), ("Y", ("y",))])
    assert [r["license"] for r in own.collect()] == ["X", None, "Y"]  # sentences of a caller's, one of them without a word


def test_telling_words_are_in_each_sentence():
    words = license_scan.telling_words(license_scan.SENTENCES)
    assert len(words) < 8 and all(any(w in s.split() for w in words) for s in license_scan.SENTENCES)
    assert license_scan.telling_words({"#": "x", "alpha": "y"}) == [] and license_scan.telling_words({}) == []


# op7
def test_wrapped_licenses(spark):
    mit = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    led = lambda text, lead: "\n".join((lead + line).rstrip() for line in text.split("\n"))
    texts = [mit, gpl, "no stop before\nLicensed under the\nMIT License\nnor after", "not licensed under the\nMIT License", "# Licensed under the MIT License", "licensed under the apache license version #", "Permission is\n\nhereby granted"]
    rows = list(enumerate(texts)) + [(10 + 10 * k + i, led(t, lead)) for k, lead in enumerate(["# ", "// ", " * ", ";; ", "dnl ", "! "]) for i, t in enumerate([mit, gpl])]
    got = {r["n"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "n long, text string")).collect()}
    for n in got:
        if n >= 10 or n < 2:
            assert got[n]["sentence_ids"] == [["mit-grant", "mit-notice", "mit-as-is"], ["gpl-grant", "gpl-hope"]][n % 10], n
    assert [got[n]["sentence_ids"] for n in range(2, 7)] == [["mit-tag"], [], ["mit-tag"], [], []]
    con = __import__("duckdb").connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*rows, (1000, None)])
    sql = {r[0]: r[1:] for r in con.execute(license_scan.OP6_SQL).fetchall()}
    assert sql == {n: (r["license"], ",".join(r["licenses"]), len(r["sentence_ids"])) for n, r in got.items()} | {1000: (None, "", 0)}


HEADS = {
    "Apache": """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR""",
    "LGPL": """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.""",
    "AGPL": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU Affero General Public License for more details.

    You should have received a copy of the GNU Affero General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "MPL": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "CC-BY-NC-SA": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0\nInternational License.",
    "GPL": "// SPDX-License-Identifier: GPL-2.0-or-later",
}


def test_public_licence_texts(spark):
    got = {r["k"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(list(HEADS.items()), "k string, text string")).collect()}
    assert got == {k: k for k in HEADS}
    without = HEADS["BSD-3-Clause"].split("\n\n")
    two = spark.createDataFrame([("\n\n".join(without[:3] + without[4:]),)], "text string")
    assert license_scan.scan_licenses(two).first()["license"] == "BSD-2-Clause"


def test_training_sample_of_copies(spark):
    texts = spark.createDataFrame([(f"text number {i}",) for i in range(200)], "text string")
    u = [(r["text"], r["u"] / 2.0**62) for r in texts.select("text", F.xxhash64("text").bitwiseAND(2**62 - 1).alias("u")).orderBy("u").collect()]
    high = [t for t, x in u if x > 0.5][:3]
    rows = [("few", t) for t in high for _ in range(100)] + [("many", u[0][0])] * 300 + [("many", t) for t, _ in u[1:]]
    got = language_id.training_sample(spark.createDataFrame(rows, "lang string, text string"), 10).collect()
    assert sorted(r["text"] for r in got if r["lang"] == "few") == sorted(high) and {r["n_lang"] for r in got if r["lang"] == "few"} == {300}
    assert sorted(r["text"] for r in got if r["lang"] == "many") == sorted(t for t, _ in u[:10])


def brute_lines(rows, least=10):
    key = lambda l: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in l.strip(" \t\n\x0b\f\r"))
    n = Counter(k for _, t in rows for k in {key(l) for l in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [l for l in lines if n[key(l)] < least or not key(l)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = ["Read more", " read MORE\t", "", "  ", "Été", "été", "A ", "unique line", "b"] + [make(rng, 3) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n".join(["Read more"] * 3000 + ["end"])), (5, rows[5][1]), (None, "Read more\nx"), (None, "y\nRead more")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kept string")
    got = line_dedup.drop_repeated_lines(df, 10, 1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("h")).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


# op8
def test_leaks(spark):
    rng = random.Random(6)
    bench = [(i, make(rng, rng.randint(15, 60))) for i in range(40)] + [(90, "too short"), (91, None), (None, make(rng, 20))]
    clean = [(i, make(rng, rng.randint(1, 200))) for i in range(300)]
    leaks = [(1000 + i, make(rng, 80) + " " + b.upper().replace(" ", ",\n") + " " + make(rng, 50)) for i, (_, b) in enumerate(bench[:20])]
    half = []
    for i, (_, b) in enumerate(bench[20:30]):
        w = b.split()
        for k in range(0, len(w), 5):
            w[k] = "changed"
        half.append((2000 + i, make(rng, 30) + " " + " ".join(w)))
    edge = [(3000, None), (3001, ""), (3002, bench[0][1] + " end"), (3002, bench[0][1] + " end"), (3003, make(rng, 30_000) + " " + bench[1][1])]
    docs = spark.createDataFrame([(i, t, "c") for i, t in clean + leaks + half + edge], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, b).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(1000 + i, i) for i in range(20)} | {(2000 + i, 20 + i) for i in range(10)} | {(3002, 0), (3003, 1)}
    assert decontamination.find_leaks(docs.limit(0), b).count() == 0 and decontamination.find_leaks(docs, b.limit(0)).count() == 0


def test_leaks_of_more_passages_than_the_rank(spark):
    rng = random.Random(61)
    bench = [(i, make(rng, rng.randint(8, 60))) for i in range(2000)]
    common = " ".join(rng.choice(WORDS) for _ in range(12))
    bench += [(2000 + i, common) for i in range(50)]  # its runs are in more passages than RARE
    rows = [(i, make(rng, 40) + " " + t + " " + make(rng, 40)) for i, t in bench] + [(10_000 + i, make(rng, 100)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(2000)} | {(2000 + i, 2000 + j) for i in range(50) for j in range(50)}


def test_short_items_are_compared_literally(spark):
    bench = [("yes", 1), ("forty two", 2), ("the answer is seven", 3), ("Seven, is the answer!", 4), ("the answer is seven", 5), ("", 6), ("alpha beta gamma delta epsilon zeta eta", 7)]
    docs = [("a", "yes"), ("b", "yes sir"), ("c", "Forty-two"), ("d", "so the ANSWER\nis seven today"), ("e", "the answer is"), ("f", "x " * 500 + "alpha beta gamma delta epsilon zeta eta"), (None, "seven is the answer"), ("g", None)]
    df, b = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(i, t) for t, i in bench], "item_id long, text string")
    want = {("a", 1), ("c", 2), ("d", 3), ("d", 5), ("f", 7), (None, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, b).collect()} == want
    long = make(random.Random(62), 30)
    got = decontamination.find_leaks(df.union(spark.createDataFrame([("h", long)], df.schema)), b.union(spark.createDataFrame([(8, long)], b.schema))).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {("h", 8)} and all(r["lcs_share"] == 1 for r in got)


def test_paraphrases_against_brute_force(spark):
    """Items with words changed and left out, against all windows compared with all passages in the full space."""
    rng = random.Random(63)
    bench = [make(rng, rng.randint(20, 58)) for _ in range(120)]
    texts = []
    for t in bench:
        words = [rng.choice(WORDS) + "x" if rng.random() < 0.2 else w for w in t.split() if rng.random() > 0.1]
        texts.append(make(rng, rng.randint(0, 60)) + " " + " ".join(words) + " " + make(rng, rng.randint(0, 60)))
    texts += [make(rng, 150) for _ in range(100)]
    n = Counter(w for t in texts for w in set(t.split()))
    idf = {w: np.log((2 + len(texts)) / (1 + n[w])) for w in n} | {w: np.log(2 + len(texts)) for t in bench for w in t.split() if w not in n}
    vector = lambda ws: {w: c * idf[w] for w, c in Counter(ws).items()}
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    want = set()
    for d, t in enumerate(texts):
        ws = t.split()
        starts = [min(k * decontamination.STRIDE, max(len(ws) - decontamination.WINDOW, 0)) for k in range(max(1, -(-(len(ws) - decontamination.WINDOW) // decontamination.STRIDE) + 1))]
        windows = [(a, vector(ws[a : a + decontamination.WINDOW])) for a in starts]
        for i, p in enumerate(bench):
            pw = p.split()
            pv = vector(pw)
            for a, v in windows:
                if sum(x * pv.get(w, 0) for w, x in v.items()) >= decontamination.COSINE * size(v) * size(pv):
                    around = ws[max(0, a - len(pw)) : a + decontamination.WINDOW + len(pw)]
                    names = {w: k for k, w in enumerate(pw)}
                    share = decontamination.common_subsequence(np.array([names[w] for w in pw]), np.array([names.get(w, -1) for w in around])) / len(pw)
                    answer = pw[-max(2, len(pw) // 4) :]
                    if share >= decontamination.STRONG or share >= decontamination.WEAK and np.mean([w in around for w in answer]) >= decontamination.ANSWER:
                        want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).collect()}
    assert len(want) > 90 and len(want & got) >= 0.97 * len(want)
    assert got <= {(i, i) for i in range(120)}


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(-1, 6, rng.integers(0, 40))
        assert decontamination.common_subsequence(a, b) == slow(a.tolist(), b.tolist())


# op9
def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.9, 0.6, 0.3):
        a, b = ids[:300], ids[int(300 * (1 - share)) :][:300]
        wa, wb = 1 + (a % np.uint64(7)).astype(np.float32), 1 + (b % np.uint64(5)).astype(np.float32)
        s, w, at = np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a), len(a) + len(b)])
        x = near_dedup.consistent_samples(s, w, at, 2000)
        wm = {i: v for i, v in zip(a.tolist(), wa.tolist())}, {i: v for i, v in zip(b.tolist(), wb.tolist())}
        keys = set(wm[0]) | set(wm[1])
        true = sum(min(wm[0].get(k, 0), wm[1].get(k, 0)) for k in keys) / sum(max(wm[0].get(k, 0), wm[1].get(k, 0)) for k in keys)
        assert abs((x[0] == x[1]).mean() - true) < 0.04


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows = [(i, make(rng, rng.randint(1, 120))) for i in range(200)]
    base = make(rng, 100)
    rows += [(1000 + i, base) for i in range(30)]
    for i in range(25):  # near copies of one text
        w = base.split()
        w[rng.randint(0, 99)] = f"edit{i}"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000, None), (3001, None), (3002, ""), (3003, " "), (3004, "!!! ???"), (3005, "!!! ???"), (7, rows[7][1]), (None, base), (3006, rows[8][1].upper() + "!!"), (3007, make(rng, 20_000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["class_id"], r["is_kept"], r["n_copies"]))
    # brute force: components of Jaccard >= 0.8 over five-word shingles (weights differ by 20 % at most, no pair is close)
    toks = {i: re.findall(r"[a-z0-9_]+", (t or "").lower()) for i, t in rows if i is not None}
    sh = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in toks.items() if w}
    comp = {i: i for i in sh}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sh)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            j = len(sh[a] & sh[b]) / len(sh[a] | sh[b])
            if j >= 0.8:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    for i in sh:
        assert {c for c, _, _ in by[i]} == {root(i)}, i
        assert {k for _, k, _ in by[i]} == ({True, False} if i == 7 else {root(i) == i})  # of two equal rows one is kept
    assert by[3000] == {(3000, True, 1)} and by[3002] == {(3002, True, 1)} and by[3005] == {(3004, False, 2)} and by[None] == {(1000, False, 31)}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("total", range(7))
def test_short_texts_alone_in_a_partition(spark, total):
    """A stretch of so few words that shingles are longer than it."""
    for texts in ([" ".join("abcdef"[:total])], [" ".join("abcdef"[:total]), None, ""], ["a"] * total):
        runs = list(near_dedup._runs(texts))
        assert sum(len(s) for _, s, _, _ in runs) == (sum(bool(t) for t in texts) if total < 6 or len(texts) > 3 else 2)
    if total not in (2, 3):
        return
    df = spark.createDataFrame([(1, " ".join("abcdef"[:total])), (2, None)], "doc_id long, text string").repartition(2)
    assert {r["is_kept"] for r in near_dedup.near_duplicates(df).collect()} == {True}


def test_ids_of_any_kind(spark):
    rows = [("x", "one two three"), (None, "one two three"), ("x", "four five six"), ("b", "four five six"), (None, "seven eight"), (None, "Seven, eight!"), ("n/a", "nine")]
    got = sorted(((r["doc_id"], r["n"], r["class_id"], r["is_kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id string, text string, n long"), row="n").collect()), key=lambda r: r[1])
    assert [(c, k) for _, _, c, k in got] == [("x", True), ("x", False), ("b", False), ("b", True), (None, True), (None, False), ("n/a", True)]


def weighted_classes(texts, table, threshold=0.8):
    """Brute force: components of all pairs of texts by their weighted Jaccard similarity."""
    sets = [dict(zip(s.tolist(), w.tolist())) for s, w in (near_dedup._weighted(t, table) for t in texts)]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum(min(v, sets[j][k]) for k, v in a.items() if k in sets[j])
            if both >= (sum(a.values()) + sum(sets[j].values()) - both) * threshold:
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("split", [8192, 20])
def test_large_buckets_lose_no_link(spark, monkeypatch, split):
    """Chains of edits, of which leaders find few: the closing comparison finds the rest, as brute force does."""
    for name, value in {"SMALL": 2, "LEADERS": 1, "ROUNDS": 1, "BLOCK": 16, "SPLIT": split, "COLUMNS": 64}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(14)
    texts = []
    for _ in range(3):
        words = make(rng, 90).split()
        for i in range(30):  # each step edits one more word: neighbours are near, ends are not
            words[rng.randint(0, 89)] = f"edit{rng.randint(0, 10**9)}"
            texts.append(" ".join(words))
            if i % 10 == 9:
                words = words[45:] + words[:45]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    table = near_dedup.shingle_weights(*near_dedup.document_frequencies(df))
    want = weighted_classes(texts, table)
    assert [got[i] for i in range(len(texts))] == want and 3 <= len(set(want)) < 60


def test_shingle_weights_hold_as_the_corpus_grows():
    """Cells crowded by a hundred rare shingles each still tell rare from common ones."""
    rng = np.random.default_rng(3)
    n, width = 2_000_000, near_dedup.SKETCHES << near_dedup.DF_BITS
    df = rng.poisson(100, width).astype(float)
    common = rng.integers(0, 2**63, 4).astype(np.uint64)
    for c in near_dedup._cells(common):
        np.add.at(df, c, [n // 1000, n // 100, n // 3, n])
    w = near_dedup._weights(common, np.ones(4), near_dedup.shingle_weights(df, n)).tolist()
    rare = near_dedup._weights(rng.integers(0, 2**63, 1000).astype(np.uint64), np.ones(1000), near_dedup.shingle_weights(df, n))
    assert w == sorted(w, reverse=True) and w[3] < 1.001 and w[0] < 1.11 and np.quantile(rare, 0.01) > 1.15


def test_word_hashes_across_pieces():
    rng = random.Random(10)
    texts = [make(rng, rng.randint(0, 9)) for _ in range(50)] + [None, "", "a" * 3_000_000, make(rng, 300_000)] + ["Ünïcode Wörter", "ünïcode wörter"]
    alone = [np.concatenate([h for _, h, _ in word_hashes([t])]) for t in texts]
    seen = 0
    for first, h, at in word_hashes(texts):
        for k in range(len(at) - 1):
            assert (h[at[k] : at[k + 1]] == alone[first + k]).all()
            seen += 1
    assert seen == len(texts) and (alone[-1] == alone[-2]).all() and len(alone[53]) == 300_000
    s, at = shingles(np.arange(1, 12, dtype=np.uint64), np.array([0, 7, 7, 8, 11]), 5)
    assert np.diff(at).tolist() == [3, 0, 1, 1]


# op10
def page(body, nav, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var a="<p>";</script></head><body><nav><ul>{"".join(f"<li><a href=/{x}>{x}</a></li>" for x in nav)}</ul></nav><div class="ad">Buy {nav[0]}</div><article>{body}</article>{extra}<footer>&copy; x</footer></body></html>'


def test_html_extraction(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(40):
        paras = [make(rng, rng.randint(3, 20)) for _ in range(rng.randint(1, 6))]
        body = f"<h1>Head &amp; {i}</h1>" + "".join(f"<p>{p.replace(' ', '  <b>x</b> ', 1)}<br>" + ("</p>" if k % 2 else "") for k, p in enumerate(paras))
        if i % 5 == 0:
            body += "<ul><li>one<li>two</ul>"
        extra = '<section class="comments"><article><p>Nice!</p></article></section><aside>side</aside><form>f</form>' if i % 4 == 0 else ""
        rows.append((i, f"https://h{i % 3}.example/{i}", page(body, [f"m{k}" for k in range(rng.randint(1, 5))], extra)))
        want[i] = "\n\n".join([f"Head & {i}", *[p.replace(" ", " x ", 1) for p in paras], *(["one", "two"] if i % 5 == 0 else [])])
    rows += [(100, None, page("<p>q</p>", ["a"])), (101, "https://h0.example/n", None), (102, "https://h0.example/e", ""), (103, "x", "plain text, no tags"), (104, "https://h9.example/", "<p>" + "w " * 60_000), (0, rows[0][1], rows[0][2]), (105, "https://h8.example/", "<div><p>a < b & c</div><p title='x>y'>d")]
    want |= {100: "q", 101: "", 102: "", 103: "plain text, no tags", 104: " ".join(["w"] * 60_000), 105: "a < b & c\n\nd"}
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, text int")
    got = html_extract.extract_main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def kinds_of(source):
    return [k for k in html_extract.Page(source).kinds if k != "_"]


def test_wrapper_generalises():
    pages = [page("<h1>a</h1><p>b</p><p>c</p>", ["x"]), page("<h1>d</h1><p>e</p>", ["y", "z", "w"])]
    w = html_extract.Wrapper(html_extract.infer(pages))
    many = kinds_of(page("<h1>n</h1>" + "<p>m</p>" * 9, ["q"] * 7))
    numbers = w.read(many)
    assert [w.kinds[i] for i in numbers] == many and len(set(numbers)) < len(many)  # the nine paragraphs share slots
    assert w.read(kinds_of("<p>other</p>")) is None
    seen = [x for x in w.flat if isinstance(x, dict)]
    assert {x["pages"] for x in seen} == {2} and sum(x["words"] for x in seen) == sum(len(html_extract.Page(p).texts[i].split()) for p in pages for i, k in enumerate(html_extract.Page(p).kinds) if k == "#")


def unmarked(rng, i):
    """A page without any role: a slogan, links, an advert, the article in plain divisions, terms of use that never change."""
    paras = [make(rng, rng.randint(30, 60)) for _ in range(rng.randint(1, 4))]
    links = "".join(f"<div><a href=/{k}>{make(rng, 1)}</a></div>" for k in range(rng.randint(2, 5)))
    body = f"<div><span>all the news</span></div><div>{links}</div><div>{make(rng, 3)}</div><div><h1>head {i}</h1>{''.join(f'<p>{p}</p>' for p in paras)}<div>share this page</div></div><div>terms of use apply to all of it</div>"
    return f"<html><head><title>t</title></head><body>{body}</body></html>", "\n\n".join([f"head {i}", *paras])


def test_slots_decide_without_roles(monkeypatch):
    """What a host's pages held in each slot finds the article where no element is marked; without the wrapper nothing is found."""
    rng = random.Random(15)
    made = [unmarked(rng, i) for i in range(20)]
    of = html_extract.Extractor(html_extract.infer([s for s, _ in made]))
    assert [of(s) for s, _ in made] == [t for _, t in made]
    one = html_extract.Extractor(html_extract.infer([made[0][0]]))  # one page alone can't tell what is fixed
    assert one(made[0][0]) != made[0][1]
    other = made[0][0].replace("<h1>", "<table><tr><td>1</td></tr></table><h1>", 1)  # a kind of page that the wrapper doesn't fit
    assert of.wrapper.read(kinds_of(other)) is None and of(other) == "1\n\n" + made[0][1]
    monkeypatch.setattr(html_extract, "infer", lambda sources: [])
    none = html_extract.Extractor(html_extract.infer([s for s, _ in made]))
    assert {none(s) for s, _ in made} == {""}


def test_wrappers_are_learned_from_all_pages(spark):
    """Of a host's 60 pages spread over partitions, those read last have a part that the first don't; all are in its wrapper."""
    rng = random.Random(16)
    made = [unmarked(rng, i) for i in range(60)]
    rows = [(i, f"http://a.example/{i}", s.replace("<h1>", "<blockquote>q</blockquote><h1>") if i > 50 else s) for i, (s, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    (row,) = html_extract.infer_wrappers(df).collect()
    w = html_extract.Wrapper(__import__("json").loads(row["wrapper"]))
    assert max(x["pages"] for x in w.flat if isinstance(x, dict)) == 60 and "blockquote" in w.kinds
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    assert got == {i: ("q\n\n" + t if i > 50 else t) for i, (_, t) in enumerate(made)}


def test_deep_and_broken_pages():
    for source in ("<i>" * 20_000 + "deep", "<div>" * 5000 + "x" + "</div>" * 5000, "</p></div>", "a < b", "<!-- open", "<td>" * 300 + "y"):
        text = html_extract.Extractor(html_extract.infer([source]))(source)
        assert text == {"<i": "deep", "<d": "x", "<t": "y", "a ": "a < b"}.get(source[:2], ""), source[:20]


def test_kinds_of_page_too_large_together_are_both_kept(monkeypatch):
    """Two kinds of page that can't be aligned within the bounds: what both learned is kept, whichever comes first, and read by."""
    monkeypatch.setattr(html_extract, "MAX_NODES", 16)
    rng = random.Random(17)
    made = [unmarked(rng, i) for i in range(12)]
    other = [(s.replace("<body>", "<body><table><tr><td><b>old</b></td></tr></table>").replace("<h1>", "<blockquote>same words</blockquote><h1>"), t) for s, t in made]
    dumped = __import__("json").dumps
    a, b = (html_extract.infer([s for s, _ in x]) for x in (made, other))
    for w in (html_extract.infer([s for pair in zip(made, other) for s, _ in pair]), html_extract.widened(a, b), html_extract.widened(b, a)):
        assert dumped(w).count('"pages": 12') >= 8 and '"blockquote"' in dumped(w)
        of = html_extract.Extractor(w)
        assert [of(s) for s, _ in made + other] == [t for _, t in made + other]  # the fixed quotation, too, is known to be fixed
        assert html_extract.widened(w, w) and len(dumped(html_extract.widened(w, w))) < 1.1 * len(dumped(w))
