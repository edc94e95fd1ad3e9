"""Corpus-wide removal of repeated lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timeloom.plans.scratch import materialise

BLANK = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text, split at ``\\n`` only; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(key: Column) -> Column:
    """128 bits in two longs: at 10^12 distinct lines a single long would already confuse a few."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Add ``kept, n_lines, n_dropped`` to documents with a ``text`` column; the rows themselves all stay.

    A line's key (see ``line_key``) of at least ``min_chars`` code points that occurs in at least ``min_docs``
    rows loses all its lines in every row; the rest is joined by ``\\n``. Every row counts as a document, repeated
    rows too, and a key counts once per row. Null or empty texts have one line, which is never dropped.
    Other columns are kept; columns named like the three results are replaced.

    Only 16-byte hashes with positions are exploded and shuffled, not the lines: the positions to drop come back
    to their text by a key of the whole text, and the kept stretches between them are sliced out of the line array.
    A common line is counted by map-side partial sums. The two slim sides are written first: Spark then knows their
    size, and splits skewed partitions in a join only if nothing but an exchange is below it.
    """
    keyed = docs.drop("kept", "n_lines", "n_dropped").withColumns({"_lines": lines_of(F.col("text")), "_row": _hashes(F.coalesce(F.col("text"), F.lit("")))})
    keys = F.transform("_lines", line_key)
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, _hashes(k)))
    exploded = keyed.select(F.explode(F.array_distinct(hashed)).alias("h")).where("h is not null")
    common = materialise(exploded.groupBy("h").count().where(F.col("count") >= min_docs).select("h"), "common-lines")
    at = keyed.select("_row", F.posexplode(hashed).alias("pos", "h")).where("h is not null")
    drops = at.join(common, "h", "left_semi").groupBy("_row").agg(F.sort_array(F.collect_set("pos")).alias("_drop"))
    drops = materialise(drops, "dropped-lines")
    joined = keyed.join(drops, "_row", "left")
    d, n = F.coalesce("_drop", F.array().cast("array<int>")), F.size("_lines")
    # stretch i runs from after the (i-1)-th dropped position to before the i-th
    stretches = F.transform(
        F.zip_with(F.concat(F.array(F.lit(-1)), d), F.concat(d, F.array(n)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda s: F.slice(F.col("_lines"), s["a"] + 2, s["b"] - s["a"] - 1),
    )
    return joined.withColumns({"kept": F.array_join(F.flatten(stretches), "\n"), "n_lines": n.cast("long"), "n_dropped": F.size(d).cast("long")}).drop("_lines", "_row", "_drop")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs, 10, 1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
with l as (
  select doc_id, u.line, u.pos,
    translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents) d,
    lateral (select unnest(d.lines) as line, unnest(range(len(d.lines))) as pos) u),
common as (select k from l where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select l.doc_id, count(*) as n_lines, count(c.k) as n_dropped,
  sha256(coalesce(string_agg(case when c.k is null then l.line end, chr(10) order by l.pos), '')) as kept_sha256
from l left join common c using (k) group by l.doc_id
"""
