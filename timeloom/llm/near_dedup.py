"""Near-duplicate documents by improved consistent weighted sampling of TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from timeloom.llm.sums import summed
from timeloom.llm.words import mix, shingles, word_hashes
from timeloom.operators.graph import connected_components
from timeloom.plans.scratch import materialise, small_batches

#: Words a shingle; bands and samples a band: pairs at 0.8 share a band with probability 1 - (1 - 0.8^3)^10 = 0.9992.
WORDS, BANDS, ROWS = 5, 10, 3
#: Document frequencies are counted in SKETCHES tables of 2^DF_BITS cells by shingle hash (8 MB together at any input size).
DF_BITS, SKETCHES, DF_BLOCK = 19, 2, 1024
#: A shingle's weight is its count times 1 + IDF_SHARE * idf / largest idf: boilerplate counts less, but a large group
#: of copies, whose own shingles are frequent, isn't torn apart by the few rare ones of each edit.
IDF_SHARE = 0.2
#: Buckets up to this size are compared pair by pair; larger ones first with LEADERS leaders in each of ROUNDS rounds.
SMALL, LEADERS, ROUNDS = 8, 4, 2
#: What the leaders leave in several classes is compared in blocks of BLOCK texts; buckets of over SPLIT are split before.
BLOCK, SPLIT = 512, 8192
#: Columns of the matrices that a pair of blocks is compared in.
COLUMNS = 4096


def _runs(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of texts: number of the first, distinct shingles sorted within each text, their counts, offsets."""
    for first, hashes, offsets in word_hashes(texts):
        s, at = shingles(hashes, offsets, WORDS)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new)
        tf = np.diff(np.concatenate([starts, [len(s)]]))
        yield first, s[starts], tf, np.searchsorted(doc[starts], np.arange(len(at)))


def _cells(s: np.ndarray) -> Iterator[np.ndarray]:
    """The cells of shingles in each sketch, numbered through."""
    for j in range(SKETCHES):
        yield ((s >> np.uint64(64 - DF_BITS * (j + 1))) & np.uint64((1 << DF_BITS) - 1)).astype(np.int64) + (j << DF_BITS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per shingle cell over all texts (the sketches one after another), and the number of documents with a word.

    A task counts in arrays and sends blocks of them, which are summed in two steps. Only the summed cells, whose number
    doesn't depend on the input, come to the driver.
    """
    width = SKETCHES << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(width + 1)
        for b in batches:
            for _, s, _, at in _runs(b.column(0).to_pylist()):
                for c in _cells(s):
                    out[:width] += np.bincount(c, minlength=width)
                out[width] += int((np.diff(at) > 0).sum())
        return out

    found = summed(docs.select("text"), count, width + 1)
    return found[:width], int(found[width])


def shingle_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Weight of a single occurrence by the shingle's cell in each sketch: between 1 (in every document) and 1 + IDF_SHARE (in one).

    A cell also counts the shingles it shares, on average as many as the other cells hold. That mean is taken off, so
    what is left of the noise is the root of a cell's load, and its share of all documents falls as they grow in number.
    """
    out = []
    for cells in df.reshape(SKETCHES, -1):
        alone = np.clip(cells - (cells.sum() - cells) / (len(cells) - 1), 1, max(n, 1))
        out.append(1 + IDF_SHARE * np.log((1 + n) / (1 + alone)) / np.log((3 + n) / 2))
    return np.concatenate(out).astype(np.float32)


def _weights(s: np.ndarray, tf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Counts times the weight by the sketch in which the shingle seems rarest: a crowded cell counts too many, never too few by much."""
    return tf * np.maximum.reduce([table[c] for c in _cells(s)])


_GAMMA: list[np.ndarray] = []


def _gamma_table() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 2^16 even steps, by bisection of its distribution function."""
    if not _GAMMA:
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        lo, hi = np.zeros(1 << 16), np.full(1 << 16, 40.0)
        for _ in range(50):
            x = (lo + hi) / 2
            low = 1 - np.exp(-x) * (1 + x) < u
            lo, hi = np.where(low, x, lo), np.where(low, hi, x)
        _GAMMA.append(x.astype(np.float32))
    return _GAMMA[0]


def consistent_samples(s: np.ndarray, w: np.ndarray, at: np.ndarray, samples: int, first: int = 0) -> np.ndarray:
    """Improved consistent weighted sampling: for each text with shingles, ``samples`` numbers (from the ``first`` on) that
    two texts share with a probability equal to their weighted Jaccard similarity.

    For sample k and shingle s, r and c ~ Gamma(2, 1) and b ~ U(0, 1) are fixed by a hash of both;
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r, and the shingle with the smallest a is taken
    together with its t.
    """
    gamma = _gamma_table()
    starts = at[:-1]
    log_w = np.log(w).astype(np.float32)
    low = (s & np.uint64(0xFFFFFFFF)) ^ (s >> np.uint64(32))
    out = np.empty((len(starts), samples), np.uint64)
    for k in range(samples):
        z = (s ^ np.uint64((0x9E3779B97F4A7C15 * (first + k + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xC4CEB9FE1A85EC53)
        z ^= z >> np.uint64(29)
        r = gamma[(z & np.uint64(0xFFFF)).astype(np.int32)]
        b = ((z >> np.uint64(16)) & np.uint64(0xFFF)).astype(np.float32) * np.float32(1 / 4096)
        u = (((z >> np.uint64(28)) & np.uint64(0x3FFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-18)
        v = ((z >> np.uint64(46)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-18)
        t = np.floor(log_w / r + b)
        log_a = np.log(-np.log(u * v)) - r * (t - b) - r
        bits = log_a.view(np.int32)
        order = np.where(bits < 0, ~bits, bits ^ np.int32(-(2**31))).view(np.uint32).astype(np.uint64)
        tag = (low ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x85EBCA6B))) & np.uint64(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat((order << np.uint64(32)) | tag, starts) & np.uint64(0xFFFFFFFF)
    return out


def band_hashes(s: np.ndarray, w: np.ndarray, at: np.ndarray, first: int = 0) -> np.ndarray:
    """A hash per text and band, of ROWS samples each."""
    x = consistent_samples(s, w, at, BANDS * ROWS, first)
    h = np.zeros((len(at) - 1, BANDS), np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + x[:, j::ROWS])
    return h.view(np.int64)


def _text_key() -> dict[str, Column]:
    """128 bits of the raw text, by which texts are found again without a document's id."""
    return {"ka": F.xxhash64("text"), "kb": F.xxhash64(F.lit(7), F.col("text"))}


def signatures(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, row, ka, kb, same, bands, rarity`` for ``doc_id, row, text``: a hash that texts with the same words share,
    a hash per band, and the mean weight of the text's shingles: low for texts made of what many documents share.

    Texts without words have null bands, and ``same`` by the raw text (null for null and blank texts, which are like none).
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 4 MB at any size of the input

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            same, bands, rarity = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            for first, s, tf, at in _runs(texts):
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    w, starts = _weights(s, tf, weights), np.append(at[:-1][full], at[-1])
                    mean = np.add.reduceat(w, starts[:-1]) / np.add.reduceat(tf, starts[:-1])
                    h = band_hashes(s, w, starts)
                    for i, d in enumerate(full):
                        bands[first + d], rarity[first + d] = h[i].tolist(), float(mean[i])
            for first, hashes, offsets in word_hashes(texts):
                powers = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
                for d in range(len(offsets) - 1):
                    own = hashes[offsets[d] : offsets[d + 1]]
                    if len(own):
                        same[first + d] = f"{int((own * powers[: len(own)]).sum()):x}.{int((mix(own) ^ powers[: len(own)] * own).sum()):x}"
            for i, t in enumerate(texts):
                if same[i] is None and t and not t.isspace():
                    same[i] = "raw " + t if len(t) < 64 else f"raw {int(mix(np.frombuffer(t.encode('utf-32-le', 'surrogatepass'), np.uint32).astype(np.uint64) * mix(np.arange(1, len(t) + 1, dtype=np.uint64))).sum()):x}"
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "ka", "kb")), pa.array(same, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(rarity, pa.float64())], ["doc_id", "row", "ka", "kb", "same", "bands", "rarity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", *[c.alias(k) for k, c in _text_key().items()], "text").mapInArrow(sign, f"doc_id {kind}, row long, ka long, kb long, same string, bands array<long>, rarity double")


def similarity(pairs: DataFrame, table: np.ndarray) -> DataFrame:
    """Add ``similarity``, the weighted Jaccard similarity of the shingles of ``text_a`` and ``text_b``; drops the texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
            if text not in kept:
                if len(kept) > 40:
                    kept.clear()
                kept[text] = _weighted(text, weights)
            return kept[text]

        for b in batches:
            out = []
            for x, y in zip(b.column("text_a"), b.column("text_b")):
                (s1, w1), (s2, w2) = weighted(x.as_py()), weighted(y.as_py())
                _, i, j = np.intersect1d(s1, s2, assume_unique=True, return_indices=True)
                both = float(np.minimum(w1[i], w2[j]).sum())
                out.append(both / (float(w1.sum()) + float(w2.sum()) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


def _weighted(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and their weights."""
    for _, s, tf, _ in _runs([text]):
        return s, _weights(s, tf, table)
    return np.zeros(0, np.uint64), np.zeros(0, np.float32)


def links_between(texts: list[str], classes: np.ndarray, side: np.ndarray, table: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar texts of different classes, one of side 0 and one of side 1 (any two if all are of one side):
    enough of them that whatever such pairs connect is connected.

    A shingle that stands k times becomes k elements of its weight, so that the weight two texts share is a product of
    0/1 matrices with the weights between them; elements that stand in one text alone are left out, and the rest are
    multiplied COLUMNS at a time. Similarities are exact, and memory is bounded by the texts of two blocks.
    """
    elements, owner, weight, total = [], [], [], np.zeros(len(texts))
    for i, t in enumerate(texts):
        for _, s, tf, _ in _runs([t]):
            w = _weights(s, np.ones(len(s)), table)
            nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
            elements.append(mix(np.repeat(s, tf) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            weight.append(np.repeat(w, tf))
            owner.append(np.full(len(nth), i))
            total[i] = (w * tf).sum()
    _, e, n = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    common = n[e] > 1
    column = np.cumsum(n > 1) - 1
    e, owner, weight = column[e[common]], np.concatenate(owner)[common], np.concatenate(weight)[common]
    order = np.argsort(e, kind="stable")
    e, owner, weight = e[order], owner[order], weight[order]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() and not side.all() else (np.arange(len(texts)),) * 2
    row_of, col_of = np.full(len(texts), -1), np.full(len(texts), -1)
    row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)))
    for start in range(0, int(e[-1]) + 1 if len(e) else 0, COLUMNS):
        a, z = np.searchsorted(e, (start, start + COLUMNS))
        x, y, at = np.zeros((len(left), COLUMNS)), np.zeros((len(right), COLUMNS)), e[a:z] - start
        r, c = row_of[owner[a:z]], col_of[owner[a:z]]
        x[r[r >= 0], at[r >= 0]] = weight[a:z][r >= 0]
        y[c[c >= 0], at[c >= 0]] = 1
        both += x @ y.T
    near = both >= (total[left][:, None] + total[right][None] - both) * (threshold - 1e-9)
    near &= classes[left][:, None] != classes[right][None]
    root = {c: c for c in classes.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(near)):
        p, q = find(int(classes[left[i]])), find(int(classes[right[j]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(left[i]), int(right[j])))
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, row: str | None = None) -> DataFrame:
    """``doc_id, class_id, is_kept, n_copies`` for each row of ``docs`` (``doc_id, text``), and the column ``row`` if named.

    A class is a connected component of texts whose weighted Jaccard similarity over five-word shingles is at least
    ``threshold`` (see ``shingle_weights``). One row of it is kept, that with the smallest doc_id (nulls last, then the
    smallest ``row``, a column of distinct longs; by default rows are numbered here), and class_id is its doc_id. doc_ids
    may be of any orderable type, null or repeated: texts are what is compared, and rows with one doc_id and different
    texts are different documents. Texts with the same words in the same order are one text: ``n_copies`` counts its rows.
    Texts without words are alike if they are equal; null, empty and blank texts are alone, and kept.

    Equal bands make candidates. In buckets of up to SMALL texts all pairs are compared. In larger ones each text is
    compared with the bucket's leaders, the texts with the most common shingles: edits of one text are nearest to its
    least edited forms. Texts not similar to any leader meet the next leaders once more. A large group of near copies so
    falls into few classes at a few comparisons each. Then the texts of buckets that still hold several classes are
    compared between classes, all of them, in pairs of blocks (``links_between``), so no link inside a bucket is lost.
    """
    numbered = docs.select("doc_id", "text", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    with small_batches(docs.sparkSession):
        out = _near_duplicates(numbered, threshold)
    return out.withColumnRenamed("row", row) if row else out.drop("row")


def _near_duplicates(docs: DataFrame, threshold: float) -> DataFrame:
    table = shingle_weights(*document_frequencies(docs))
    signed = materialise(signatures(docs, table), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "ka", "kb")).alias("first")
    texts = signed.where("same is not null").groupBy("same").agg(first, F.count("*").alias("n_copies"), F.any_value("bands").alias("bands"), F.min("rarity").alias("rarity"))
    texts = materialise(texts.withColumn("rep", F.monotonically_increasing_id()), "distinct-texts")
    members = texts.where("bands is not null").select("rep", "rarity", F.posexplode("bands").alias("band", "hash"))
    sizes = materialise(members.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialise(members.join(sizes, ["band", "hash"]), "members")
    keys = texts.select("rep", "first.ka", "first.kb", F.col("first.doc_id").alias("id"))
    bodies = _texts_of(members.select("rep").distinct(), docs, keys)
    known = _links(members, lambda pairs: _verify(pairs, bodies, table), threshold)
    parts = connected_components(known, "a", "b")
    late = _close(members, parts, bodies, table, threshold)
    if late is not None:
        parts = connected_components(known.unionByName(late), "a", "b")
    info = texts.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("same", "first", "n_copies", F.coalesce("component", "rep").alias("class"))
    info = materialise(info, "classes")
    keepers = materialise(info.groupBy("class").agg(F.min("first").alias("keeper")), "keepers")
    info = materialise(info.join(keepers, "class").select("same", "keeper", "n_copies"), "kept")
    out = signed.select("doc_id", "row", "same").join(info, "same", "left")
    class_id = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("row") == F.col("keeper.row"), F.lit(True)).alias("is_kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "row")


def _links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Similar pairs ``a, b`` of small buckets, and of members of large ones (``rep, rarity, band, hash, n``) with their leaders."""
    small = members.where(F.col("n") <= SMALL).groupBy("band", "hash").agg(F.sort_array(F.collect_set("rep")).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice(F.col("r"), i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    fresh = small.select(F.explode(pairs).alias("p")).select("p.*")
    large = members.where(F.col("n") > SMALL)
    rest, known = large.select("rep", "band", "hash"), None
    for round_no in range(ROUNDS):
        nth = F.row_number().over(Window.partitionBy("band", "hash").orderBy("rarity", "rep"))
        leaders = large.withColumn("nth", nth).where(F.col("nth") <= LEADERS * (round_no + 1)).where(F.col("nth") > LEADERS * round_no).select("band", "hash", F.col("rep").alias("leader"))
        met = materialise(rest.join(leaders, ["band", "hash"]).where("rep <> leader"), "meetings")
        led = met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))
        fresh = (led if round_no else fresh.unionByName(led)).distinct()
        if known is not None:
            fresh = fresh.join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = materialise(verify(materialise(fresh, "candidates")), "verified")
        known = found if known is None else known.unionByName(found)
        if round_no + 1 < ROUNDS:
            close = known.where(F.col("similarity") >= threshold).select("a", "b")
            hit = met.withColumns({"a": F.least("rep", "leader"), "b": F.greatest("rep", "leader")}).join(close, ["a", "b"], "left_semi")
            rest = materialise(rest.join(hit.select("band", "hash", "rep").distinct(), ["band", "hash", "rep"], "left_anti"), "rest")
            if rest.isEmpty():
                break
    return materialise(known.where(F.col("similarity") >= threshold).select("a", "b"), "links")


def _close(members: DataFrame, parts: DataFrame, bodies: DataFrame, table: np.ndarray, threshold: float) -> DataFrame | None:
    """Links ``a, b`` between classes within large buckets, None if no such bucket holds two classes.

    Buckets of over SPLIT members are dealt anew by further bands of other samples first: of texts that share a passage
    and little else few stay together, and similar ones meet in one of those bands as surely as in the first.
    """
    large = members.where(F.col("n") > SMALL).select("rep", "band", "hash").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    large = materialise(large.select("rep", "band", "hash", F.coalesce("component", "rep").alias("class")), "classed")
    mixed = lambda d: materialise(d.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("band", "hash", "n"), "mixed-buckets")
    buckets = mixed(large)
    if buckets.isEmpty():
        return None
    open_ = materialise(large.join(buckets, ["band", "hash"]), "open-members")
    shared = members.sparkSession.sparkContext.broadcast(table)
    huge = open_.where(F.col("n") > SPLIT)
    if not huge.isEmpty():

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for t in b.column("text").to_pylist():
                    s, w = _weighted(t, shared.value)
                    out.append(band_hashes(s, w, np.array([0, len(s)]), BANDS * ROWS)[0].tolist())
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(out, pa.list_(pa.int64()))], ["rep", "more"])

        bands = materialise(bodies.join(huge.select("rep").distinct(), "rep", "left_semi").select("rep", "text").mapInArrow(more, "rep long, more array<long>"), "more-bands")
        dealt = huge.drop("n").join(bands, "rep").select("rep", "class", "band", F.posexplode("more").alias("i", "h"), "hash")
        dealt = materialise(dealt.select("rep", "class", (F.col("band") * 100 + F.col("i") + 100).alias("band"), F.xxhash64("hash", "h").alias("hash")), "dealt-members")
        open_ = open_.where(F.col("n") <= SPLIT).unionByName(dealt.join(mixed(dealt), ["band", "hash"]))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = open_.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.select("rep", "class", "band", "hash", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def close(group: pa.Table) -> pa.Table:
        rep, classes = group.column("rep").to_numpy(), group.column("class").to_numpy()
        found = links_between(group.column("text").to_pylist(), classes, group.column("side").to_numpy(), shared.value, threshold) if len(np.unique(classes)) > 1 else []
        return pa.table({"a": pa.array([int(rep[i]) for i, _ in found], pa.int64()), "b": pa.array([int(rep[j]) for _, j in found], pa.int64())})

    met = own.join(bodies, "rep").groupBy("band", "hash", "p", "q").applyInArrow(close, "a long, b long")
    return materialise(met.distinct(), "late-links")


def _texts_of(reps: DataFrame, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``rep, text`` of the texts numbered ``rep``, which all comparisons read: one scan of the documents and one shuffle of their
    texts. The wanted keys grow with the documents, so they are merged, not broadcast, at every size."""
    wanted = materialise(keys.join(reps, "rep", "left_semi"), "compared")
    found = docs.where("text is not null").select("doc_id", "text", *[c.alias(k) for k, c in _text_key().items()])
    found = found.join(wanted.hint("merge"), (found["ka"] == wanted["ka"]) & (found["kb"] == wanted["kb"]) & found["doc_id"].eqNullSafe(wanted["id"]))
    return materialise(found.select("rep", "text").dropDuplicates(["rep"]), "compared-texts")


def _verify(pairs: DataFrame, texts: DataFrame, table: np.ndarray) -> DataFrame:
    """Similarity of candidate pairs (a, b) of numbered texts."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return similarity(both, table)


def op9_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
