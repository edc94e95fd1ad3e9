"""Language identification by compression with zstandard raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F

#: Bounds of the sample that dictionaries are made of: documents and bytes a language, letters a document at least (where a
#: language has few, as many more as fill the dictionary twice), and languages.
SAMPLE_DOCS, DICT_BYTES, LEAST_LETTERS, MAX_LANGS = 400, 110_000, 500, 400
#: Letters that are compressed at once: the dictionary's help must not be drowned by the text's own repetition.
CHUNK = 1500
#: Levels of a first pass and of a closer look at texts whose first margin is below CLOSE.
LEVELS, CLOSE = (3, 9), 0.1
#: Below this share of saved bytes between the best two languages a text is rejected.
MIN_MARGIN = 0.002
_NOISE, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """Lower-cased words, everything but letters and the marks on them as single blanks; empty without a letter."""
    plain = _NOISE.sub(" ", text.lower()).strip()
    return plain if _LETTER.search(plain) else ""


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``per_lang`` distinct texts (``lang, text``) of each language, those with the smallest hash.

    Counts of distinct texts by language set a threshold on the hash, so that a language with most of the rows sends
    about four times ``per_lang`` texts to the ranking, however many and however often copied it has them. Rows without text or lang take no part. Of a text twice as many characters come
    along as its letters are wanted of (``letters_each``). ``n_lang`` is the
    language's count over all rows, by which ties between languages are settled later.
    """
    d = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = d.groupBy("lang", "h").count().groupBy("lang").agg(F.count("*").alias("texts"), F.sum("count").alias("rows")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return d.select("lang", "text", F.lit(0).alias("n_lang")).limit(0)
    share, size, most = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0))
    for r in counts:
        most = most.when(F.col("lang") == r["lang"], F.lit(2 * letters_each(min(per_lang, r["texts"]))))
        share = share.when(F.col("lang") == r["lang"], F.lit(min(1.0, 4 * per_lang / r["texts"])))
        size = size.when(F.col("lang") == r["lang"], F.lit(r["rows"]))
    low = d.withColumn("u", F.col("h").bitwiseAND(2**62 - 1) / 2.0**62).where(F.col("u") < share)
    texts = low.groupBy("lang", "h", "u").agg(F.min("text").alias("text"))
    ranked = texts.withColumn("n_lang", size).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("u", "text")))
    return ranked.where(F.col("n") <= per_lang).select("lang", F.left("text", most).alias("text"), "n_lang")


def letters_each(texts: int, size: int = DICT_BYTES) -> int:
    """Letters that each of so many sampled texts of a language may give to its dictionary."""
    return max(LEAST_LETTERS, 2 * size // max(1, texts))


def make_dictionaries(sample: DataFrame, size: int = DICT_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary per language, the most frequent language first: letters of the sampled texts, shortest
    texts last, where matches are cheapest."""
    found: dict[str, list[str]] = {}
    frequent: dict[str, int] = {}
    for r in sample.toLocalIterator():
        found.setdefault(r["lang"], []).append(letters(r["text"]))
        frequent[r["lang"]] = r["n_lang"]
    made = {}
    for lang, texts in found.items():
        each = letters_each(len(texts), size)
        blob = " ".join(sorted((t[:each] for t in set(texts) if t), key=lambda t: (-len(t), t))).encode()[-size:]
        if blob:
            made[lang] = blob
    return dict(sorted(made.items(), key=lambda x: (-frequent[x[0]], x[0])))


class Classifier:
    def __init__(self, dictionaries: Mapping[str, bytes]):
        import zstandard

        self.langs, self.coders = list(dictionaries), []
        for level in LEVELS:
            of_level = []
            for blob in dictionaries.values():
                raw = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=level)
                of_level.append(zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False))
            self.coders.append(of_level)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; ``und`` with zeros for texts without letters."""
        plain = letters(text) if text else ""
        if not plain or not self.langs:
            return "und", 0.0, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        parts = [plain[i : i + CHUNK].encode() for i in range(0, len(plain), CHUNK)]
        for of_level in self.coders:
            sizes = [sum(len(c.compress(p)) for p in parts) for c in of_level]
            ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
            best, second = sizes[ranked[0]], sizes[ranked[1]]
            margin = (second - best) / second
            if margin >= CLOSE:
                break
        return self.langs[ranked[0]], second / (best + second), margin


def identify(docs: DataFrame, dictionaries: Mapping[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add ``lang_pred, score, margin, rejected`` to documents by their whole ``text`` alone.

    Letters are compressed in stretches with each language's dictionary, and the smallest sum of bytes wins (ties go to
    the language with more labelled rows). ``score`` is the runner-up's share of both sums, 0.5 to 1; ``margin`` the share of bytes
    saved against the runner-up. Null texts and texts without letters are ``und`` with score 0 and rejected; so is
    everything if no dictionary could be learned. Margins below ``min_margin`` are rejected too, but keep their prediction.
    Columns named like the results are replaced. The dictionaries' size is bounded by MAX_LANGS and DICT_BYTES.
    """
    fixed = dict(dictionaries)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = Classifier(fixed)
        for texts in batches:
            yield pd.DataFrame([of(t) for t in texts], columns=["lang_pred", "score", "margin"]).astype({"lang_pred": "object", "score": "float64", "margin": "float64"})

    found = docs.drop("lang_pred", "score", "margin", "rejected").withColumn("_found", classify("text"))
    found = found.withColumns({c: F.col("_found")[c] for c in ("lang_pred", "score", "margin")}).drop("_found")
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < min_margin))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op3_zstd_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    made = make_dictionaries(training_sample(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("text", "lang")))
    return identify(docs.select("doc_id", "text"), made).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
