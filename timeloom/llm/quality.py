"""Quality of documents by histogram gradient-boosted trees over statistics of their whole texts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from timeloom.plans.scratch import materialise

#: Labelled documents that a classifier is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Trees, their depth, bins of a statistic, learning rate, least sum of second derivatives in a leaf and what is added to it.
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 120, 4, 64, 0.1, 2.0, 1.0
#: Sections of a text whose extremes count, and characters that a section has at least.
SECTIONS, SECTION = 12, 200
#: Texts that are scored at once.
AT_ONCE = 512

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?", "shout": b"!", "comma": b",", "colon": b":;", "quote": b"'\"`", "bracket": b"()[]{}<>",
    "symbol": b"#$%&*@^~", "rule": b"|/\\_=+-", "blank": b" \t", "other": bytes(range(128, 256)),
}
_KIND_OF = np.full(256, len(_KINDS), np.uint8)
for _n, _chars in enumerate(_KINDS.values()):
    _KIND_OF[list(_chars)] = _n
#: Kinds whose largest share of a section counts as well.
_PEAKS = ["upper", "digit", "shout", "symbol", "rule", "bracket"]
STATISTICS = [
    "log_chars", *(f"{k}_share" for k in _KINDS), *(f"{k}_peak" for k in _PEAKS), "entropy", "compressed", "log_words", "word_mean", "word_spread", "word_longest", "distinct_words", "top_word",
    "caps_words", "repeated_triples", "sentence_words", "log_lines", "line_mean", "line_spread", "repeated_lines", "ended_lines",
]


def statistics(text: str | None) -> list[float]:
    """The text's values of STATISTICS. Null and empty texts have zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    kinds = _KIND_OF[np.frombuffer(data, np.uint8)]
    n, k = len(data), len(_KINDS) + 1
    shares = np.bincount(kinds, minlength=k) / n
    parts = max(1, min(SECTIONS, n // SECTION))
    cuts = [n * i // parts for i in range(parts + 1)]
    sections = np.stack([np.bincount(kinds[a:b], minlength=k) for a, b in zip(cuts, cuts[1:])])
    peaks = (sections / sections.sum(1, keepdims=True)).max(0)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    nw, nl = len(words), len(lines)
    lengths = np.fromiter(map(len, words), np.int64, nw)
    widths = np.fromiter(map(len, lines), np.int64, nl)
    of_word = Counter(words)
    triples = max(0, nw - 2)
    full = [x for x in lines if x.strip()]
    return [
        float(np.log1p(len(text))), *shares[:-1].tolist(), *(float(peaks[list(_KINDS).index(x)]) for x in _PEAKS), float(-(p * np.log2(p)).sum()), len(zlib.compress(data, 1)) / n,
        float(np.log1p(nw)), *((float(lengths.mean()), float(lengths.std()), float(lengths.max())) if nw else (0.0, 0.0, 0.0)), len(of_word) / nw if nw else 0.0, max(of_word.values()) / nw if nw else 0.0,
        sum(map(str.isupper, words)) / nw if nw else 0.0, 1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples else 0.0, nw / (1 + counts[46] + counts[33] + counts[63]),
        float(np.log1p(nl)), float(widths.mean()), float(widths.std()), 1 - len(set(full)) / len(full) if full else 0.0, sum(x.rstrip().endswith((".", "!", "?")) for x in full) / len(full) if full else 0.0,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: node ``i`` of a tree has the children ``2 i + 1`` and ``2 i + 2``; the last level are leaves."""

    edges: list[np.ndarray]  # of each statistic, upper bounds of its bins
    feature: np.ndarray  # trees x inner nodes
    bin: np.ndarray  # values in bins up to this one go left
    leaf: np.ndarray  # trees x leaves
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.int16) if len(self.edges) else np.zeros((len(x), 0), np.int16)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all trees of all rows going down a level at a time."""
        trees, inner = self.feature.shape
        b, each = self.binned(x), np.arange(trees)[None]
        node = np.zeros((len(x), trees), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (b[rows, self.feature[each, node]] > self.bin[each, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[each, node - inner].sum(1))))


def _best_splits(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes x statistics x bins of summed derivatives: best statistic, bin and gain of each node (ties: the first)."""
    gl, hl = g.cumsum(2), h.cumsum(2)
    gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gl[:, :, -1:] ** 2) / (hl[:, :, -1:] + RIDGE)
    gain = np.where((hl >= LEAST) & (hr >= LEAST), gain, 0.0).reshape(len(g), -1)
    best = gain.argmax(1)
    return best // g.shape[2], best % g.shape[2], gain.max(1)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees that lower the logistic loss one after another; splits are found in histograms of binned statistics.

    Without rows all scores are 0.5. Nodes that no split improves send all rows to the left child.
    """
    inner, leaves = 2**depth - 1, 2**depth
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if n else np.zeros(0) for i in range(k)]
    prior = np.log((y.sum() + 1) / (n - y.sum() + 1)) if n else 0.0
    model = Trees(edges, np.zeros((trees if n else 0, inner), np.int64), np.full((trees if n else 0, inner), bins, np.int64), np.zeros((trees if n else 0, leaves)), float(prior))
    if not n:
        return model
    b = model.binned(x).astype(np.int64)
    cell = b + np.arange(k)[None] * bins
    raw, rows = np.full(n, prior), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * bins) + cell).ravel()
            hist = [np.bincount(at, np.repeat(v, k), wide * k * bins).reshape(wide, k, bins) for v in (g, h)]
            feature, cut, gain = _best_splits(*hist)
            good = gain > 1e-9
            model.feature[t, first : first + wide] = np.where(good, feature, 0)
            model.bin[t, first : first + wide] = np.where(good, cut, bins)
            node = 2 * node + 1 + (b[rows, model.feature[t, node]] > model.bin[t, node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        model.leaf[t] = value
        raw += value[leaf]
    return model


def text_statistics(text) -> F.Column:
    """``statistics`` of a text column as an array."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return of(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``stats, label`` of at most ``rows`` labelled documents (``docs``: ``doc_id, text``; ``labels``: ``doc_id`` and the label).

    Labels that are null or neither 0 nor 1, and ids whose labels differ, teach nothing; of the other ids those with the smallest
    hash are taken. Where several documents have one id, the smallest statistics count, once.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    chosen = materialise(known.select("doc_id", "label").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows), "labelled")
    return docs.join(chosen, "doc_id").select("doc_id", "label", text_statistics("text").alias("stats")).groupBy("doc_id").agg(F.min("stats").alias("stats"), F.min("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on ``labelled_sample``: at most ``rows`` rows of numbers come to the driver; no text does."""
    got = labelled_sample(docs, labels, label, rows).orderBy("doc_id").select("stats", "label").toArrow()
    x = np.array(got.column("stats").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit_trees(x, got.column("label").to_numpy().astype(float))


def with_quality(docs: DataFrame, model: Trees, least: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if ``score >= least``, else 0) by the whole ``text`` alone.

    Null and empty texts are scored by their statistics, all zeros. Repeated rows score alike, an empty table stays empty,
    other columns stay; columns named like the results are replaced.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.scores(np.array([statistics(t) for t in texts[i : i + AT_ONCE]], float)) for i in range(0, len(texts), AT_ONCE)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.drop("score", "predicted").withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= least).cast("int"))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op13_boosted_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return with_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
