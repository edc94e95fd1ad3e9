"""Terms of a table in texts: against a plain search, by a user's table, on poor rows."""

import random
import re

from timeloom.operators import lexicon as L

TEXT, LEX = "id long, text string", "kind string, term string"


def test_hits_equal_a_plain_search(spark, monkeypatch):
    rng = random.Random(4)
    words = ["in", "the", "end", "in the", "the end", "end in the", "it's", "café", "i", "end_"]
    texts = [(i, rng.choice(["", "- ", "É"]) + rng.choice([" ", "  \n", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 30))).title()) for i in range(200)]
    lex = [("a", "in"), ("a", "THE  end"), ("b", "in"), ("b", "end in the"), ("b", "it's"), ("c", "caf"), ("c", "unseen"), ("a", "in")]
    want = set()
    for i, text in texts:
        plain = re.sub("^[^a-z0-9']+", "", re.sub("[ \t\n\r]+", " ", text.lower()).strip(" "))
        for kind, term in {(k, re.sub(" +", " ", t.lower())) for k, t in lex}:
            found = [m.start() for m in re.finditer(f"(?<![a-z0-9_])(?={re.escape(term)}(?![a-z0-9_]))", plain)]
            if found:
                want.add((i, kind, term, len(found), found[0]))
    t, x = spark.createDataFrame(texts, TEXT), spark.createDataFrame(lex, LEX)
    rows = sorted(map(tuple, L.lexicon_hits(t, x, ["id"]).collect()))
    assert rows == sorted(want) and {r[2] for r in rows} >= {"in", "the end", "end in the", "caf"}
    monkeypatch.setattr(L, "PART_LETTERS", 10)
    assert sorted(map(tuple, L.lexicon_hits(t, x, ["id"]).collect())) == rows


def test_a_users_table_changes_the_roles(spark):
    turns = spark.createDataFrame([(1, "Now to SUM up:", False), (2, "Zusammengefasst gut.", True), (3, "Who knows", False), (4, "I know who", True), (5, None, None)], "id long, text string, guest boolean")
    roles = lambda lex: {r.id: r.role for r in L.roles_by_lexicon(turns, lex, ["id"]).collect()}
    assert roles(L.default_lexicon(spark)) == {1: "conclusion", 2: "answer", 3: "question", 4: "answer", 5: "monologue_statement"}
    own = spark.createDataFrame([("conclusion", "zusammengefasst"), ("story", "who")], LEX)
    assert roles(own) == {1: "monologue_statement", 2: "conclusion", 3: "story", 4: "story", 5: "monologue_statement"}


def test_poor_rows(spark):
    t = spark.createDataFrame([(1, None), (2, ""), (3, "é è"), (4, "word " * 100_000), (4, "word")], TEXT)
    x = spark.createDataFrame([("k", "word"), (None, "word"), ("k", None), ("k", " ")], LEX)
    assert sorted(map(tuple, L.lexicon_hits(t, x, ["id"]).collect())) == [(4, "k", "word", 1, 0), (4, "k", "word", 100_000, 0)]
    assert L.lexicon_hits(t, x.limit(0), ["id"]).collect() == [] and L.lexicon_hits(t.limit(0), x, ["id"]).collect() == []
