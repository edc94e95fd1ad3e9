"""Token counts by a SentencePiece BPE model, with a shortcut for whole tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

SPACE = "▁"
#: Counts of pre-tokens that a worker keeps; beyond, it forgets them and starts anew.
REMEMBERED = 400_000


class PieceCounter:
    """Counts tokens as the model's ``encode`` gives them, pre-token by pre-token.

    The model writes a blank as U+2581 and puts one before the text. Merges make nothing but vocabulary
    pieces, so no merge crosses a place where no piece of several characters has the two neighbours next to
    each other. What is proved here from the vocabulary, before any text is read:

    * no piece has a blank after another character, and none holds a line feed with another character, so texts
      fall apart before runs of blanks and around line feeds, and the parts count alone;
    * which blank-led strings the model encodes alone as one token: those count one and are never merged.

    Models that fail a proof (pieces across blanks, a normaliser, other settings, user-defined pieces) are refused.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        real = [p for i, p in enumerate(pieces) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(SPACE in p.lstrip(SPACE) for p in real) or any("\n" in p and len(p) > 1 for p in real):
            raise ValueError("pieces cross blanks or line feeds")
        probes = {"": [], " ": [SPACE * 2], "a": [SPACE + "a"], "ﬁ é": None}
        for text, want in probes.items():
            if want is not None and m.encode(text, out_type=str) != want:
                raise ValueError("the model treats blanks in another way")
        if m.normalize("ﬁ  ① é ") != SPACE + "ﬁ  ① é ".replace(" ", SPACE):
            raise ValueError("the model normalises its input")
        led = [p for p in real if p.startswith(SPACE) and not p.startswith(SPACE * 2) and len(p) > 1]
        self.alone = {p for p, ids in zip(led, m.encode([p[1:] for p in led], num_threads=1)) if len(ids) == 1}
        self.known: dict[str, int] = dict.fromkeys(self.alone, 1)
        self.split = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.line_feed = len(m.encode("\n", num_threads=1))

    def _merge(self, parts: list[str]) -> list[int]:
        """Token counts of pre-tokens by the model, which puts a blank before each string it gets."""
        texts, minus = [], []
        for p in parts:
            if p[0] != SPACE:  # a line feed keeps the blank away and then counts as much as alone
                texts.append("\n" + p)
                minus.append(self.line_feed)
            elif p.strip(SPACE):
                texts.append(p[1:].replace(SPACE, " "))
                minus.append(0)
            else:  # blanks alone: behind a letter, so that the first isn't the model's own
                texts.append("\n" + " " * len(p))
                minus.append(self.line_feed)
        return [len(ids) - m for ids, m in zip(self.model.encode(texts, num_threads=1), minus)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = Counter(self.split(SPACE + text.replace(" ", SPACE)))
        total = parts.pop("\n", 0)
        known = self.known
        unknown = [p for p in parts if p not in known]
        if unknown:
            if len(known) > REMEMBERED:
                self.known = known = dict.fromkeys(self.alone, 1)
                unknown = [p for p in parts if p not in known]
            known.update(zip(unknown, self._merge(unknown)))
        return total + sum(known[p] * n for p, n in parts.items())


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_count(text: Column, model_file: str) -> Column:
    """Number of tokens of each whole text, without added tokens; null texts count as empty: 0.

    ``model_file`` must be readable on every executor.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model_file).count
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return n_tokens(text)


def with_token_counts(docs, model_file: str, limit: int = 4096):
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to documents with a ``text`` column.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted alike; an empty table stays empty;
    other columns are kept, columns named like the results replaced.
    """
    counted = docs.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "n_tokens": token_count(F.col("text"), model_file)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_piece_counts(spark, sf_dir: str):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), 4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")
