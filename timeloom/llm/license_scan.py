"""Licence recognition by sentence rules, with DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from timeloom.llm.line_dedup import LOWER, UPPER

# Sentences of public licence texts and notices, normalised as by ``marked_words``, and their identifiers.
SENTENCES: dict[str, str] = {
    "released under the mit license": "mit-tag",
    "licensed under the mit license": "mit-tag",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "licensed under the apache license version #": "apache-tag",
    "licensed under the apache license version # the license": "apache-tag",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "apache license version # january #": "apache-title",
    "terms and conditions for use reproduction and distribution": "apache-terms",
    "this work is licensed under the gnu general public license version #": "gpl-tag",
    "licensed under the gnu general public license version #": "gpl-tag",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version": "gpl-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version # as published by the free software foundation": "gpl-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "gnu general public license version # # june #": "gpl-title",
    "gnu general public license version # june #": "gpl-title",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gpl-verbatim",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "lgpl-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-hope",
    "gnu lesser general public license version # # june #": "lgpl-title",
    "gnu lesser general public license version # february #": "lgpl-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version # of the license or at your option any later version": "agpl-grant",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "gnu affero general public license version # # november #": "agpl-title",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "distributed under the boost software license version #": "bsl-tag",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-tag",
    "this source code form is subject to the terms of the mozilla public license v #": "mpl-tag",
    "mozilla public license version #": "mpl-title",
    "eclipse public license v #": "epl-title",
}
#: Identifiers of the machine-readable tag line and the short names that it may hold, normalised.
TAGS: dict[str, tuple[str, ...]] = {
    "mit-tag": ("mit",), "apache-tag": ("apache #",), "gpl-tag": ("gpl #", "gpl # only", "gpl # or later"), "lgpl-tag": ("lgpl #", "lgpl # only", "lgpl # or later"),
    "agpl-tag": ("agpl #", "agpl # only", "agpl # or later"), "bsd-tag": ("bsd # clause",), "isc-tag": ("isc",), "zlib-tag": ("zlib",), "unlicense-tag": ("unlicense",),
    "bsl-tag": ("bsl #",), "mpl-tag": ("mpl #",), "epl-tag": ("epl #",),
}
#: Kinds of the Creative Commons licences and what they are called in full.
CREATIVE = {"by": "attribution", "by-nc": "attribution noncommercial", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
SENTENCES |= {f"spdx license identifier {name}": tag for tag, names in TAGS.items() for name in names}
for _kind, _name in CREATIVE.items():
    _short = _kind.replace("-", " ")
    SENTENCES |= dict.fromkeys((f"licensed under cc {_short} #", f"spdx license identifier cc {_short} #", f"this work is licensed under a creative commons {_name} # international license"), f"cc-{_kind}-tag")
#: Rules in order of precedence: the licence, and the identifiers that must follow one another among the recognised ones.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("Apache", ("apache-tag", "apache-use", "apache-copy", "apache-as-is")),
    ("Apache", ("apache-title", "apache-terms")),
    ("AGPL", ("agpl-grant", "gpl-hope", "agpl-copy")),
    ("LGPL", ("lgpl-grant", "lgpl-hope")),
    ("GPL", ("gpl-grant", "gpl-hope", "gpl-copy")),
    ("AGPL", ("agpl-title", "gpl-verbatim")),
    ("LGPL", ("lgpl-title", "gpl-verbatim")),
    ("GPL", ("gpl-title", "gpl-verbatim")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Unlicense", ("unlicense-domain", "unlicense-grant")),
    ("BSL", ("bsl-grant",)),
    ("MPL", ("mpl-title",)),
    ("EPL", ("epl-title",)),
    ("MPL", ("mpl-tag",)),
    ("AGPL", ("agpl-grant",)),
    ("AGPL", ("agpl-tag",)),
    ("LGPL", ("lgpl-grant",)),
    ("LGPL", ("lgpl-tag",)),
    ("GPL", ("gpl-tag",)),
    ("GPL", ("gpl-grant",)),
    *((f"CC-{k.upper()}", (f"cc-{k}-tag",)) for k in sorted(CREATIVE, key=lambda k: (-len(k), k))),
    ("Apache", ("apache-tag",)),
    ("BSD", ("bsd-tag",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-tag",)),
    ("Zlib", ("zlib-tag",)),
    ("Unlicense", ("unlicense-domain",)),
    ("Unlicense", ("unlicense-tag",)),
    ("BSL", ("bsl-tag",)),
    ("EPL", ("epl-tag",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-tag",)),
)
#: Sentences that a single map expression may hold.
MAX_SENTENCES = 2000


#: Possessive and never begun inside a run, so that Java's matcher neither recurses nor goes over a long run from each of its characters.
#: Replacements, one after another, that turn a text into words and marks: comment leaders, parts and ends of sentences, line ends,
#: numbers, the rest; and the last one, by which marks that stand together become an end.
MARKS = (
    (r"(?m)^[ \t]*+(?:[;!]++|dnl\b|rem\b)", " "), (r"(?<![;:])[;:]++(?:[ \t\r]++\n?|\n)", " ~ "), (r"(?<![.!?;:])[.!?;:]++[ \t\r]++", " | "), (r"(?<![.!?;:])[.!?;:]++\n", " | ~ "), (r"\n", " ~ "),
    (r"[0-9]++(?:[.][0-9]++)*+", " # "), (r"[^a-z#|~]++", " "),
)
TOGETHER = (r" *+(?:[|~] *+){2,}+", " | ")


def marked_words(text: Column) -> Column:
    """The text's words between single blanks, with ``|`` where a sentence ends (``.``, ``!`` or ``?`` before a blank or line
    end, blank lines) and ``~`` where only a line or, at ``;`` or ``:``, a part of it does; A-Z lower-cased, numbers as ``#``, all else but
    letters left out, comment leaders too. Null gives marks alone."""
    low = F.translate(F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n")), UPPER + "#|~", LOWER + "   ")
    for pattern, mark in MARKS:
        low = F.regexp_replace(low, pattern, mark)
    return F.regexp_replace(low, *TOGETHER)


def telling_words(sentences: Mapping[str, str]) -> list[str]:
    """Few words of which each sentence has at least one: again and again the word that most of those left have (of equals
    the longest). Empty if a sentence has no word, so that nothing can be told."""
    left, out = [set(w for w in s.split() if w.isalpha()) for s in sentences], []
    while left:
        counts = Counter(w for words in left for w in words)
        if not all(left) or not counts:
            return []
        best = min(counts, key=lambda w: (-counts[w] * min(len(w), 8), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return sorted(out)


def known_sentences(text: Column, sentences: Mapping[str, str]) -> Column:
    """The known sentences of a text in order: from where a line or sentence begins to where one ends, over any number of
    lines between; the longest first where several begin."""
    longest = sorted(sentences, key=lambda s: (-len(s), s))
    pattern = "(?<=[|~] )(?:" + "|".join(s.replace(" ", "(?: ~)? ") for s in longest) + ")(?= [|~])"
    return F.transform(F.regexp_extract_all(marked_words(text), F.lit(pattern), F.lit(0)), lambda s: F.replace(s, F.lit(" ~"), F.lit("")))


def scan_licenses(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """Add ``license`` (of the first rule that matches), ``licenses`` (all, in rule order) and ``sentence_ids``.

    Each sentence known by its whole normalised form, on one line or wrapped over several, becomes an identifier; other sentences are skipped. A rule
    matches if its identifiers stand one after another in what is left. All of it happens inside the row: nothing is
    exploded or shuffled, and common licence lines make no hot group. Null and empty texts, and texts without a known
    sentence, have no licence: null, and empty arrays. Columns named like the results are replaced.
    """
    if len(sentences) > MAX_SENTENCES:
        raise ValueError(f"at most {MAX_SENTENCES} sentences")
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # cheap test first: a text without any of these words holds no sentence
    words = telling_words(sentences)
    maybe = F.translate("text", UPPER, LOWER).rlike("|".join(words)) if words else F.lit(True)
    ids = F.when(maybe, F.transform(known_sentences(F.col("text"), sentences), lambda s: F.try_element_at(known, s)))
    d = docs.withColumn("sentence_ids", F.coalesce(ids, F.array().cast("array<string>")))
    trail = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    hits = F.array(*[F.when(trail.contains("|" + "|".join(seq) + "|"), F.lit(name)) for name, seq in rules])
    d = d.withColumn("licenses", F.array_distinct(F.array_compact(hits)))
    return d.withColumn("license", F.try_element_at("licenses", F.lit(1)))


def op6_license_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "license", F.array_join("licenses", ",").alias("licenses"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def _sql() -> str:
    """The same marks; each stands twice, so that neighbouring sentences can both have one on either side. DuckDB's matcher
    is linear by itself and knows neither possessive repeats nor looking back."""
    bare = lambda p: re.sub(r"([*+}])[+]", r"\1", re.sub(r"\(\?<![^)]*\)", "", p))
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({n}, {q(name)}, {q('|' + '|'.join(seq) + '|')})" for n, (name, seq) in enumerate(RULES))
    marked = f"translate(chr(10) || coalesce(text, '') || chr(10), {q(UPPER + '#|~')}, {q(LOWER + '   ')})"
    for pattern, mark in MARKS:
        marked = f"regexp_replace({marked}, {q(bare(pattern))}, {q(mark)}, 'g')"
    marked = f"regexp_replace({marked}, {q(bare(TOGETHER[0]))}, {q(TOGETHER[1])}, 'g')"
    any_of = "|".join(s.replace(" ", "(?: ~ ~)? ") for s in sorted(SENTENCES, key=lambda s: (-len(s), s)))
    return f"""
with known(s, id) as (values {known}), rules(n, name, seq) as (values {rules}),
m as (select doc_id, replace(replace({marked}, ' ~ ', ' ~ ~ '), ' | ', ' | | ') as t from documents),
l as (select doc_id, regexp_extract_all(t, '[|~] ({any_of}) [|~]', 1) as l from m),
s as (select doc_id, unnest(l) as s, unnest(range(len(l))) as pos from l),
ids as (select doc_id, string_agg(id, '|' order by pos) as trail, count(id) as n from (select doc_id, pos, replace(s, ' ~ ~', '') as s from s) x join known using (s) group by doc_id),
hits as (select doc_id, name, min(rules.n) as n from ids join rules on contains('|' || trail || '|', seq) group by doc_id, name),
best as (select doc_id, arg_min(name, n) as license, string_agg(name, ',' order by n) as licenses from hits group by doc_id)
select d.doc_id, best.license, coalesce(best.licenses, '') as licenses, coalesce(ids.n, 0)::bigint as n_sentences
from documents d left join ids using (doc_id) left join best using (doc_id)
"""


OP6_SQL = _sql()
