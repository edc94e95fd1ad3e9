"""Term lists as a table, and texts searched for all of its terms in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from timeloom.functions import columns as C
from timeloom.operators.candidates import HOOKS
from timeloom.plans.catalog import query

#: Letters of terms that one automaton holds; a larger lexicon is searched for in several passes.
PART_LETTERS = 4_000_000
#: Default terms by kind; a user's table replaces them.
TERMS = {
    "hook": HOOKS, "question_starter": C.QUESTION_STARTERS, "conclusion": ["in conclusion", "to sum up", "finally", "at last"],
    "transition": ["moving on", "anyway", "next up"], "explanation": ["secret"], "story": ["i remember", "when i was"],
}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
_HITS = "array<struct<kind:string,term:string,hits:bigint,first:bigint>>"


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, terms in TERMS.items() for t in terms], "kind string, term string")


def _plain(text):
    """Lower case, white space as one blank, from the first letter, digit or apostrophe on."""
    return F.regexp_replace(C.clean_text(F.lower(text)), "^[^a-z0-9']+", "")


def _finder(terms: list[tuple[str, str]]):
    """A function of a series of texts that finds the terms with an Aho-Corasick automaton, built once a task."""

    @F.pandas_udf(_HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        kinds: dict[str, list[str]] = {}
        for kind, term in terms:
            kinds.setdefault(term, []).append(kind)
        machine = ahocorasick.Automaton()
        for term in kinds:
            machine.add_word(term, term)
        machine.make_automaton()

        def hits(text: str | None) -> list[dict]:
            found: dict[str, list[int]] = {}
            for last, term in machine.iter(text or "") if kinds else ():
                first, after = last - len(term) + 1, last + 1
                if (first and text[first - 1] in _WORD) or (after < len(text) and text[after] in _WORD):
                    continue
                seen = found.setdefault(term, [0, first])
                seen[0] += 1
            return [{"kind": k, "term": t, "hits": n, "first": at} for t, (n, at) in found.items() for k in kinds[t]]

        for texts in batches:
            yield texts.map(hits)

    return find


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, kind, term, hits, first``: the terms of ``lexicon`` (``kind, term``) that stand in each text as whole words or phrases.

    Case and runs of white space don't matter; letters ``a-z``, digits and ``_`` next to a match make it part of a longer word.
    ``first`` is the place of the first hit, 0 if the text begins with it. All terms are found in one pass over a text, however many there are,
    overlapping ones too. Of all data only the lexicon comes to the driver; one of over ``PART_LETTERS`` letters is searched for in as many passes as it takes. Null and empty texts and terms
    have no hits, repeated rows of the lexicon count once."""
    plain = C.clean_text(F.lower("term"))
    terms = lexicon.select("kind", plain.alias("term")).where("kind is not null and term <> ''").distinct()
    letters = terms.agg(F.sum(F.length("kind") + F.length("term"))).first()[0] or 0
    parts = max(1, -(-2 * letters // PART_LETTERS)) if letters > PART_LETTERS else 1
    passes = []
    for n in range(parts):
        part = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == n)
        find = _finder([(r.kind, r.term) for r in part.toLocalIterator()])
        passes.append(texts.select(*keys, F.explode(find(_plain(F.col(text)))).alias("_hit")).select(*keys, "_hit.*"))
    return reduce(DataFrame.unionByName, passes)


def hits_by_kind(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, kind, hits, terms, first``: hits and different terms of each kind in each text that has any; ``keys`` tell texts apart."""
    return lexicon_hits(texts, lexicon, keys, text).groupBy(*keys, "kind").agg(F.sum("hits").alias("hits"), F.count("*").alias("terms"), F.min("first").alias("first"))


def roles_by_lexicon(turns: DataFrame, lexicon: DataFrame, keys: list[str], order: tuple[str, ...] = ("conclusion", "transition", "explanation", "story")) -> DataFrame:
    """``turns`` with ``role``: a question if it has a question mark or begins with a ``question_starter``, else the first kind of
    ``order`` with a hit, else an answer (of ``guest``) or a statement."""
    # only the kinds that decide are kept, one row a turn
    own = hits_by_kind(turns, lexicon.where(F.col("kind").isin("question_starter", *order)), keys)
    own = own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kind", "first"))).alias("_first"))
    at = lambda kind: F.try_element_at("_first", F.lit(kind))
    role = F.when(F.contains("text", F.lit("?")) | (at("question_starter") == 0), "question")
    for kind in order:
        role = role.when(at(kind).isNotNull(), kind)
    role = role.when(F.col("guest"), "answer").otherwise("monologue_statement")
    return turns.join(own, keys, "left").withColumn("role", role).drop("_first")


_LEX = "lex as (select kind, term from (values " + ", ".join(f"('{k}', '{t}')" for k, terms in TERMS.items() for t in dict.fromkeys(terms)) + ") v(kind, term)), "
_LEX += r"""pt as (select *, regexp_replace(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')), '^[^a-z0-9'']+', '') as plain from fx_turns),
lh as (select video_id, turn, kind, term, len(regexp_extract_all(plain, '\b' || term || '\b')) as hits, length(regexp_extract(plain, '^(.*?)\b' || term || '\b', 1)) as first from pt, lex where regexp_matches(plain, '\b' || term || '\b')),
lk as (select video_id, turn, kind, sum(hits)::bigint as hits, count(*) as terms, min(first)::bigint as first from lh group by all)"""


@query("lexicon_hits", f"with {_LEX} select * from lk")
def turn_hits(fx_turns):
    """Hits of each kind in each turn."""
    return hits_by_kind(fx_turns, default_lexicon(fx_turns.sparkSession), ["video_id", "turn"])


@query("lexicon_roles", f"with {_LEX}, r as (select t.video_id, t.turn, t.text, t.speaker, max(case when kind = 'question_starter' and first = 0 then 1 end) as q, {', '.join(f'''max(case when kind = '{k}' then 1 end) as r{i}''' for i, k in enumerate(('conclusion', 'transition', 'explanation', 'story')))} from fx_turns t left join lk on lk.video_id = t.video_id and lk.turn = t.turn group by all) select video_id, turn, case when contains(text, '?') or q = 1 then 'question' when r0 = 1 then 'conclusion' when r1 = 1 then 'transition' when r2 = 1 then 'explanation' when r3 = 1 then 'story' when speaker = 'user' then 'answer' else 'monologue_statement' end as role from r")
def turn_roles(fx_turns):
    """Roles of turns by a table of terms."""
    t = fx_turns.select("video_id", "turn", "text", (F.col("speaker") == "user").alias("guest"))
    return roles_by_lexicon(t, default_lexicon(fx_turns.sparkSession), ["video_id", "turn"]).select("video_id", "turn", "role")
