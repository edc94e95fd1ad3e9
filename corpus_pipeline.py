"""From raw documents to an ordered training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. ``run`` applies them to the documents of ``sf_dir``, writing each result before the next stage reads it.
Rows are told apart by their text or by numbers given here, never by doc_id, which may be null, repeated or no number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timeloom.llm.decontamination import find_leaks
from timeloom.llm.language_id import identify, make_dictionaries, training_sample
from timeloom.llm.line_dedup import drop_repeated_lines, line_key, lines_of
from timeloom.llm.mixing import mix_sources
from timeloom.llm.near_dedup import near_duplicates
from timeloom.plans.scratch import materialise

#: Rows of an Arrow batch, set for the session by the first stage: texts are long, and its result is computed by who writes it.
BATCH_ROWS = 1000
#: A document that would lose more than this share of its characters is left to near-dedup whole if it is a copy.
MOST_DROPPED = 0.5
#: Likeness of near copies in line dedup, and shingles of a text by which they meet.
COPY_LIKENESS, SAMPLES = 0.8, 8
#: Column of row numbers while a stage runs.
ROW = "_corpus_pipeline_row"


def text_key() -> Column:
    """128 bits of the text, as a string; null texts have one too."""
    return F.concat_ws(".", F.xxhash64("text"), F.xxhash64(F.lit(7), F.col("text")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found by a sufficient margin; texts without letters go."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    dictionaries = make_dictionaries(training_sample(docs.select("text", "lang")))
    return identify(docs, dictionaries).where("not rejected").select(docs.columns)


def copied_texts(docs: DataFrame) -> DataFrame:
    """Keys (``_copy``, see ``text_key``) of the texts of ``docs`` that several rows have, or that are near copies of another:
    with a Jaccard of COPY_LIKENESS over five-word shingles.

    Shingles that one text alone has link nothing and are left out; of the others each text takes one by each of SAMPLES hash functions, the
    more readily the fewer texts have it. So texts that share most of their lines with everybody still meet by what
    they share with their copies. Texts with the same sample, and those with the same two, meet the two
    leaders of their bucket, whatever its size; one near copy found is enough."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 5, F.lit(0))), lambda i: F.xxhash64(F.slice("_w", i + 1, 5))))
    t = docs.select(text_key().alias("k"), words.alias("_w")).select("k", shingles.alias("shingles"))
    t = materialise(t.groupBy("k").agg(F.count("*").alias("n"), F.any_value("shingles").alias("shingles")), "mostly-repeated")
    each = t.select("k", F.explode("shingles").alias("s"))
    shared = materialise(each.groupBy("s").agg(F.count("*").alias("texts")).where("texts > 1"), "shared-shingles")
    u = lambda i: (F.xxhash64("s", F.lit(i)).bitwiseAND(2**52 - 1) + 0.5) / 2.0**52
    picks = [F.min(F.struct((-F.log(u(i)) * F.col("texts")).alias("order"), "s")).alias(f"s{i}") for i in range(SAMPLES)]
    sampled = each.join(shared, "s").groupBy("k").agg(*picks).select("k", *[F.col(f"s{i}.s").alias(f"s{i}") for i in range(SAMPLES)])
    pairs = [F.struct(F.lit(i).alias("band"), F.col(f"s{i}").alias("x"), F.lit(0).cast("long").alias("y")) for i in range(SAMPLES)]
    pairs += [F.struct(F.lit(SAMPLES + i).alias("band"), F.col(f"s{i}").alias("x"), F.col(f"s{(i + 1) % SAMPLES}").alias("y")) for i in range(SAMPLES)]
    b = materialise(sampled.select("k", F.explode(F.array(*pairs)).alias("b")).select("k", "b.*"), "sampled-shingles")
    leaders = materialise(b.groupBy("band", "x", "y").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high"), "leaders")
    met = b.join(leaders, ["band", "x", "y"]).select("k", F.explode(F.array("low", "high")).alias("leader")).where("k <> leader").distinct()
    side = lambda name, key: t.select(F.col("k").alias(key), F.col("shingles").alias(name))
    both = materialise(met, "meetings").join(side("a", "k"), "k").join(side("b", "leader"), "leader")
    like = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")) >= COPY_LIKENESS
    near = both.where(like).select(F.explode(F.array("k", "leader")).alias("k"))
    return t.where("n > 1").select("k").unionByName(near).distinct().withColumnRenamed("k", "_copy")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that ten or more documents have. All documents stay. Of those that would lose most of their
    text, the copies and near copies of one another (``copied_texts``) lose nothing here: the next stage keeps one of them, whole."""
    d = drop_repeated_lines(docs.withColumn("_was", F.char_length("text")), 10, 1)
    mostly = (F.col("n_dropped") > 0) & (F.char_length("kept") < F.col("_was") * (1 - MOST_DROPPED))
    copies = materialise(copied_texts(d.where(mostly)), "whole-copies")
    d = d.join(copies, text_key() == F.col("_copy"), "left")
    text = F.when((F.col("n_dropped") > 0) & ~(mostly & F.col("_copy").isNotNull()), F.col("kept")).otherwise(F.col("text"))
    return d.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that with the smallest doc_id (of equal ones the first)."""
    rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates(rows.select("doc_id", "text", ROW), row=ROW)
    gone = materialise(classes.where("not is_kept").select(ROW), "near-copies")
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaks = find_leaks(docs.select(text_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialise(leaks.select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return docs.join(gone, text_key() == F.col("_gone"), "left_anti").select(docs.columns)


def with_row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row in its file, by which a second scan finds it again; what isn't read from files is written first."""
    place = [F.col("_metadata.file_name").alias("_row_file"), F.col("_metadata.row_index").alias("_row_at")]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return materialise(docs, "rows").select("*", *place)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row per taken copy with its position, sources weighed 5, 2, 1 in turn. Positions are worked out without
    the texts, which are joined by their rows' places, and only those that are taken, and then sorted once."""
    rows = with_row_ids(docs)
    mixed = mix_sources(rows, (5, 2, 1)).select("_row_file", "_row_at", "size", "positions")
    taken = materialise(mixed.select("_row_file", "_row_at", "size", F.explode("positions").alias("position")), "positions")
    found = rows.select("_row_file", "_row_at", "doc_id", "text", "lang", "source").join(taken, ["_row_file", "_row_at"])
    return found.select("doc_id", "text", "lang", "source", "size", "position").orderBy("position", "doc_id")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: Compression, sampled similarity and latent retrieval have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
