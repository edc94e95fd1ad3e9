"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timeloom.llm.sums import summed
from timeloom.llm.words import shingles, word_hashes
from timeloom.plans.scratch import materialise, small_batches

#: Words of a benchmark passage at most, of a document window, and from window to window. Items of fewer than LEAST_WORDS
#: words are compared literally: as a run of words from LEAST_RUN words on, shorter ones only with whole texts.
PASSAGE, WINDOW, STRIDE, LEAST_WORDS, LEAST_RUN = 60, 24, 12, 8, 3
#: Rank of the latent space, extra directions and rounds of the randomised decomposition.
RANK, EXTRA, ROUNDS = 200, 20, 2
#: Cosine of a candidate; share of a passage's words in the longest common subsequence that suffices, alone or with
#: ``ANSWER`` of the answer's words.
COSINE, STRONG, WEAK, ANSWER = 0.35, 0.75, 0.55, 0.6
#: Words of a run that a passage must share to be compared without the latent space; runs in more passages than
#: ``RARE`` count only where a passage has none rarer. Cells in which documents of words outside the benchmark are counted.
GRAM, RARE, CELLS = 3, 32, 1 << 18
#: Bounds of the query side, which every task holds: terms and passages of the benchmark, and bytes of the latent space (by
#: which the rank falls where there are many terms, down to LEAST_RANK).
MAX_TERMS, MAX_PASSAGES, SPACE_BYTES, LEAST_RANK = 500_000, 100_000, 1 << 28, 16


@dataclass
class Benchmark:
    """The query side: terms (sorted hashes), passages as term numbers, their items and which words are the answer; and of
    short items by their number of words the sorted hashes of all their words, and their ids."""

    terms: np.ndarray
    passages: list[np.ndarray]
    items: list[int]
    answers: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def load_benchmark(benchmark: DataFrame) -> Benchmark:
    """Passages of at most PASSAGE words of each item. The answer is the column ``answer`` if there is one, else the last
    quarter of the passage. Items with a null id or without words are left out, and those of
    fewer than LEAST_WORDS words kept apart. Refuses benchmarks over the bounds."""
    has_answer = "answer" in benchmark.columns
    rows = benchmark.select(F.col("item_id").cast("long"), "text", (F.col("answer") if has_answer else F.lit(None).cast("string")).alias("answer")).where("item_id is not null").distinct().orderBy("item_id", "text", "answer").limit(MAX_PASSAGES + 1).collect()
    passages, items, answers = [], [], []
    few: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        words = np.concatenate([h for _, h, _ in word_hashes([r["text"]])] or [np.zeros(0, np.uint64)])
        if 0 < len(words) < LEAST_WORDS:
            few.setdefault(len(words), []).append((int(shingles(words, np.array([0, len(words)]), len(words))[0][0]), r["item_id"]))
        if len(words) < LEAST_WORDS:
            continue
        told = np.concatenate([h for _, h, _ in word_hashes([r["answer"]])]) if r["answer"] else None
        parts = -(-len(words) // PASSAGE)
        for p in np.array_split(words, parts):
            passages.append(p)
            items.append(r["item_id"])
            answers.append(told if told is not None and len(told) else p[-max(2, len(p) // 4) :])
    terms = np.unique(np.concatenate(passages)) if passages else np.zeros(0, np.uint64)
    if len(terms) > MAX_TERMS or len(passages) > MAX_PASSAGES or len(rows) > MAX_PASSAGES:
        raise ValueError(f"the benchmark has {len(terms)} terms and {len(passages)} passages or more")
    short = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)])) for k, v in few.items()}
    return Benchmark(terms, [np.searchsorted(terms, p) for p in passages], items, answers, short)


def cells_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def term_weights(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequency over all documents of each term, and of the words outside the benchmark by their hash's
    cell. Words that share a cell seem more frequent than they are, which can only add candidates."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        t = shared.value
        out = np.zeros(len(t) + CELLS + 1)
        width = len(t) + CELLS
        for b in batches:
            for _, h, at in word_hashes(b.column(0).to_pylist()):
                where = np.minimum(np.searchsorted(t, h), len(t) - 1)
                known = t[where] == h
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                pairs = np.unique(doc * width + np.where(known, where, len(t) + cells_of(h)))
                out[:-1] += np.bincount(pairs % width, minlength=width)
                out[-1] += int((np.diff(at) > 0).sum())
        return out

    counts = summed(docs.select("text"), count, len(terms) + CELLS + 1)
    idf = np.log((2 + counts[-1]) / (1 + counts[:-1]))
    return idf[: len(terms)], idf[len(terms) :]


def _rows(b: Benchmark, idf: np.ndarray, numbers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Normalised TF-IDF rows: term numbers and weights."""
    for p in numbers:
        t, tf = np.unique(b.passages[p], return_counts=True)
        w = tf * idf[t]
        yield t, w / np.sqrt((w * w).sum())


def rare_runs(b: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of GRAM words by which passages are found exactly: their sorted hashes, where each one's entries start (one
    more), and the entries' passages and places in them. Each passage has its rarest runs at least, so that a whole copy
    of it always shares one."""
    offsets = np.cumsum([0, *map(len, b.passages)])
    runs, at = shingles(np.concatenate([b.terms[p] for p in b.passages]), offsets, GRAM)
    passage = np.repeat(np.arange(len(b.passages)), np.diff(at))
    place = np.arange(len(runs)) - at[:-1][passage]
    order = np.lexsort((place, passage, runs))
    runs, passage, place = runs[order], passage[order], place[order]
    first = np.append(True, (runs[1:] != runs[:-1]) | (passage[1:] != passage[:-1]))
    runs, passage, place = runs[first], passage[first], place[first]
    _, of, n = np.unique(runs, return_inverse=True, return_counts=True)
    least = np.full(len(b.passages), len(b.passages))
    np.minimum.at(least, passage, n[of])
    keep = (n[of] <= RARE) | (n[of] == least[passage])
    grams, starts = np.unique(runs[keep], return_index=True)
    return grams, np.append(starts, keep.sum()), passage[keep], place[keep]


def latent_space(spark, b: Benchmark, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' TF-IDF matrix A, by a distributed randomised decomposition:
    rounds of orthonormalised A^T A Q from a random Q, then the rotation that diagonalises (A Q)^T A Q. Tasks hold rows
    of A; what comes to the driver is terms x rank and rank x rank, within the benchmark's bounds."""
    rank = min(RANK, len(b.passages), len(b.terms), max(LEAST_RANK, SPACE_BYTES // (8 * len(b.terms)) - EXTRA))
    width = min(rank + EXTRA, len(b.terms))
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(b.terms), width)))[0]
    shared = spark.sparkContext.broadcast((b, idf))
    numbers = spark.range(len(b.passages))

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        held = spark.sparkContext.broadcast(q)

        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            (bench, weights), m = shared.value, held.value
            out = np.zeros((width, width) if gram else m.shape)
            for batch in batches:
                for t, w in _rows(bench, weights, batch.column(0).to_pylist()):
                    y = w @ m[t]
                    if gram:
                        out += np.outer(y, y)
                    else:
                        out[t] += np.outer(w, y)
            return out.reshape(-1)

        x = summed(numbers, count, width * width if gram else q.size)
        held.unpersist()
        return x.reshape(width, width) if gram else x.reshape(q.shape)

    for _ in range(ROUNDS):
        q = np.linalg.qr(product(q, False))[0]
    values, turn = np.linalg.eigh(product(q, True))
    return q @ turn[:, np.argsort(-values)[:rank]]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays of numbers, bit-parallel over the first."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = masks.get(y)
        if m is not None:
            u = row & m
            row = (row + u) | (row - u)
            row &= full
    return len(a) - row.bit_count()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, lcs_share``: which documents (``doc_id, text``) hold a passage of which benchmark item
    (``item_id, text``), one row per pair with the best passage's figures.

    TF-IDF weights come from all documents. Every window of WINDOW words of every whole text is projected into the latent
    space of the benchmark's passages. Passages with a cosine of at least COSINE are candidates; the words around the
    window are then compared with the passage: a longest common subsequence of STRONG of its words, or of WEAK of them
    with ANSWER of the answer's words nearby, is a leak. The cosine's denominator counts words outside the benchmark, so a
    window with too little weight inside its vocabulary is passed over without changing a result. Where passages outnumber
    the rank, the space holds only a share of each, and COSINE is asked of that share.

    Passages that share a rare run of words with the text are candidates too, whatever the rank (see ``rare_runs``), so
    that no whole copy is lost. Their similarity is the cosine of as many words as the passage has, in the full space.

    Short items (fewer than LEAST_WORDS words) are leaks where all their words stand in a row, those of one or two words
    where they are the whole text; both figures are 1 then.

    doc_ids may be of any type. Documents go through one map over their texts (and one for the counts); only hits are shuffled. Null, empty and very
    short texts have no or one shorter window; texts and null ids repeated give the same pair once. Without documents,
    items or words the result is empty.
    """
    with small_batches(docs.sparkSession):
        return _find_leaks(docs, benchmark)


def _find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, lcs_share double"
    bench = load_benchmark(benchmark)
    if not bench.passages:
        return _best(docs.select("doc_id", "text").mapInArrow(_literal(bench.short), schema)) if bench.short else spark.createDataFrame([], schema)
    idf, outside = term_weights(docs, bench.terms)
    space = latent_space(spark, bench, idf)
    of_passages = np.array([w @ space[t] for t, w in _rows(bench, idf, range(len(bench.passages)))])
    held = np.maximum(np.linalg.norm(of_passages, axis=1), 1e-12)
    of_passages /= held[:, None]
    least = (COSINE * np.minimum(held, 1)).astype(np.float32)
    shared = spark.sparkContext.broadcast((bench, idf, outside.astype(np.float32), (space * idf[:, None]).astype(np.float32), of_passages.astype(np.float32), least, rare_runs(bench)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, weights, beyond, project, latent, least, (grams, entries, of_entry, place) = shared.value
        terms, squares, squares_beyond = b.terms, weights**2, beyond.astype(np.float64) ** 2
        lookup = dict(enumerate(b.passages))
        lowest, step = float(least.min()), max(16, min(1000, (1 << 23) // len(latent)))

        def cosine(words: np.ndarray, window: np.ndarray, hashes: np.ndarray) -> float:
            inside = window >= 0
            t, tf = np.unique(window[inside], return_counts=True)
            x = tf * weights[t]
            _, tf_beyond = np.unique(hashes[~inside], return_counts=True)
            far = tf_beyond * beyond[cells_of(np.unique(hashes[~inside]))]
            u, n = np.unique(words, return_counts=True)
            y = n * weights[u]
            _, i, j = np.intersect1d(t, u, assume_unique=True, return_indices=True)
            size = np.sqrt(((x**2).sum() + (far**2).sum()) * (y**2).sum())
            return min(1.0, float((x[i] * y[j]).sum() / size)) if size else 0.0
        for batch in batches:
            hits: dict[tuple[int, int], tuple[float, float]] = {}
            for first, h, at in word_hashes(batch.column(1).to_pylist()):
                if not len(h):
                    continue
                hits |= dict.fromkeys(((first + d, item) for d, item in short_runs(b.short, h, at)), (1.0, 1.0))
                where = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                known = terms[where] == h
                term = np.where(known, where, -1)
                w2 = np.where(known, squares[where], squares_beyond[cells_of(h)])
                total, inside = (np.concatenate([[0.0], np.cumsum(x)]) for x in (w2, np.where(known, w2, 0.0)))
                n = np.diff(at)
                runs, of_doc = shingles(h, at, GRAM)
                spot = np.minimum(np.searchsorted(grams, runs), len(grams) - 1)
                shares = np.flatnonzero(grams[spot] == runs)
                many = entries[spot[shares] + 1] - entries[spot[shares]]
                entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(entries[spot[shares]], many)
                in_doc = np.repeat(np.arange(len(n)), np.diff(of_doc))[shares]
                places = np.repeat(shares - of_doc[:-1][in_doc] + at[:-1][in_doc], many)
                in_doc = np.repeat(in_doc, many)
                order = np.lexsort((places, of_entry[entry], in_doc))
                last, beyond_place = None, 0
                for d, p, x, own in zip(in_doc[order].tolist(), of_entry[entry[order]].tolist(), places[order].tolist(), place[entry[order]].tolist()):
                    words, key = lookup[p], (first + d, b.items[p])
                    if (d, p) == last and x < beyond_place:
                        continue  # what is around it has been compared
                    last, beyond_place = (d, p), x + len(words)
                    lo, hi = max(at[d], x - len(words)), min(at[d + 1], x + 2 * len(words) + GRAM)
                    share = common_subsequence(words, term[lo:hi]) / len(words)
                    if share >= WEAK:
                        begin = min(max(at[d], x - own), max(at[d], at[d + 1] - len(words)))
                        end = min(begin + len(words), at[d + 1])
                        near = cosine(words, term[begin:end], h[begin:end])
                        if share >= STRONG or near >= COSINE and np.isin(b.answers[p], h[lo:hi]).mean() >= ANSWER:
                            hits[key] = max(hits.get(key, (0.0, 0.0)), (share, near))
                per = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
                doc = np.repeat(np.arange(len(n)), per)
                nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                start = at[:-1][doc] + np.minimum(nth * STRIDE, np.maximum(n[doc] - WINDOW, 0))
                end = np.minimum(start + WINDOW, at[1:][doc])
                norm = np.sqrt(total[end] - total[start])
                good = np.flatnonzero((inside[end] - inside[start] >= (lowest * norm) ** 2) & (norm > 0))
                for k in range(0, len(good), step):
                    g = good[k : k + step]
                    size = end[g] - start[g]
                    begin = np.cumsum(size) - size
                    word = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(start[g], size)
                    t = term[word]
                    rows = project[np.maximum(t, 0)]
                    rows[t < 0] = 0
                    near = (np.add.reduceat(rows, begin, axis=0) @ latent.T) / norm[g, None]
                    for i, p in zip(*np.nonzero(near >= least)):
                        d, words = doc[g[i]], lookup[p]
                        key = (first + d, b.items[p])
                        if hits.get(key, (0.0, 0.0))[0] >= 1:
                            continue  # nothing is a better copy
                        lo, hi = max(at[d], start[g[i]] - len(words)), min(at[d + 1], end[g[i]] + len(words))
                        share = common_subsequence(words, term[lo:hi]) / len(words)
                        if share >= STRONG or share >= WEAK and np.isin(b.answers[p], h[lo:hi]).mean() >= ANSWER:
                            hits[key] = max(hits.get(key, (0.0, 0.0)), (share, float(near[i, p])))
            if hits:
                yield _found(batch.column(0), hits)

    return _best(docs.select("doc_id", "text").mapInArrow(search, schema))


def _found(ids: pa.Array, hits: dict[tuple[int, int], tuple[float, float]]) -> pa.RecordBatch:
    share, near = zip(*hits.values())
    return pa.RecordBatch.from_arrays([ids.take(pa.array([d for d, _ in hits], pa.int64())), pa.array([int(i) for _, i in hits], pa.int64()), pa.array(near, pa.float64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "similarity", "lcs_share"])


def _best(found: DataFrame) -> DataFrame:
    """One row per pair: the figures of the passage of which the largest share was found."""
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "similarity")).alias("x"))
    return materialise(best.select("doc_id", "item_id", "x.similarity", "x.lcs_share"), "leaks")


def short_runs(short: dict[int, tuple[np.ndarray, np.ndarray]], h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Which texts of a stretch hold which short item."""
    for k, (hashes, items) in short.items():
        runs, of_doc = shingles(h, at, k)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(of_doc))
        size = np.diff(at)[doc]
        ok = size >= k if k >= LEAST_RUN else size == k
        runs, doc = runs[ok], doc[ok]
        low, high = np.searchsorted(hashes, runs), np.searchsorted(hashes, runs, "right")
        for i in np.flatnonzero(high > low):
            for x in range(low[i], high[i]):
                yield int(doc[i]), int(items[x])


def _literal(short: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A benchmark of short items alone."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = {(first + d, i): (1.0, 1.0) for first, h, at in word_hashes(batch.column(1).to_pylist()) if len(h) for d, i in short_runs(short, h, at)}
            if hits:
                yield _found(batch.column(0), hits)

    return search


def op8_latent_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
