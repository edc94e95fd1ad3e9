"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from timeloom.plans.scratch import materialise

#: Vectors from which centroids are fitted, rounds of fitting, most centroids a half, and entries a cell before that is reached:
#: with few, the same share of the entries holds more of the nearest.
FIT_ROWS, FIT_ROUNDS, MAX_CENTROIDS, PER_CELL = 20_000, 12, 1024, 3
#: Entries and queries that meet in one task's group, at most and at least (as many groups as the cluster has cores twice
#: over come first), and queries that are compared at once.
BLOCK, LEAST_BLOCK, AT_ONCE = 8192, 512, 512
#: Steps in which summed nearness is counted before the heap takes over.
STEPS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: id and vector not null, no null or non-finite component, not all zero."""
    e = F.col("embedding")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.elementType
    e = e if isinstance(kind, FloatType) else e.cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and embedding is not null").where(ok)


def fit_centroids(vectors: np.ndarray, k: int) -> np.ndarray:
    """k-means by Lloyd's rounds from a fixed start; empty clusters keep their centroid."""
    rng = np.random.default_rng(0)
    c = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        near = nearest_centroid(vectors, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, vectors)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centroid(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c * c).sum(1)[None]
    return np.concatenate([np.argmin(size - 2 * v[i : i + AT_ONCE] @ c.T, axis=1) for i in range(0, len(v), AT_ONCE)])


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> float:
    """How near a cell must be: cells (i, j) in the order of summed nearness ``a[i] + b[j]`` hold ``wanted`` entries down to
    the sum that is returned (that of the last cell, if all hold fewer).

    Cells are taken by a heap over the two sorted halves. Nearly all of the way is first covered in steps, by counting the
    entries between STEPS even sums: the heap starts at the frontier below them.
    """
    oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b, counts = a[oa], b[ob], counts[oa][:, ob]
    sums = a[:, None] + b[None]
    top, low = float(sums[0, 0]), float(sums[-1, -1])
    step = (top - low) / STEPS or 1.0
    at = np.minimum(((top - sums) / step).astype(np.int64), STEPS)
    held = np.cumsum(np.bincount(at.ravel(), weights=counts.ravel(), minlength=STEPS + 1))
    before = int(np.searchsorted(held, wanted))  # the step in which enough is reached
    got = int(held[before - 1]) if before else 0
    frontier = (at < before).sum(1)  # by row the first cell that isn't covered: sums fall along a row
    heap = [(-(a[i] + b[j]), i, j) for i, j in enumerate(frontier.tolist()) if j < len(b)]
    heapq.heapify(heap)
    last = low if not heap else -heap[0][0]
    while heap and got < wanted:
        near, i, j = heapq.heappop(heap)
        last = -near
        got += int(counts[i, j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
    return float(last)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows as doubles; shorter ones end in zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(flat), width))
    if len(flat):
        size = np.diff(flat.offsets.to_numpy())
        values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if (size == width).all():
            return values.reshape(-1, width)
        out[np.arange(width)[None] < size[:, None]] = values
    return out


def search(vectors: DataFrame, is_query, k: int = 20, share: float = 0.7) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each usable row of ``vectors`` (``vec_id, embedding``) where the Column
    ``is_query`` holds, its ``k`` nearest other rows found, by inner product in double precision, ties to the smaller id.

    Index: each half of the vectors has its own centroids, fitted on at most FIT_ROWS vectors (those with the smallest
    hash of their id); every vector is an entry of the cell of its two nearest centroids. Search: pairs of centroids are
    taken by summed inner product with a heap until their cells hold ``share`` of all entries (``4 * k`` at least), and
    those entries are reranked exactly. Unstructured vectors need a large share (README has recall figures).

    Equal vectors are one entry with its k + 1 smallest ids, which is all that ``k`` results can need, so copies make no
    heavy cell; equal queries are searched once. A query is sent only with the sum it goes down to, to those groups of
    lists (first centroids) that can hold such a cell; each group meets it in blocks of at most BLOCK queries and entries.
    With ``k`` or fewer candidates all are returned. Repeated ids count once per row; rows without usable vectors (see
    ``usable``) neither ask nor answer; vectors of fewer components than the longest are compared as if they ended in zeros.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "vectors")
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    entries = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialise(entries.withColumn("entry", F.element_at("ids", 1)), "entries")
    n, size = entries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    asked = rows.where(is_query)
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vector = entries.schema["embedding"].dataType.simpleString()

    sample = entries.select("embedding", F.xxhash64("entry").alias("h"), "entry").orderBy("h", "entry").limit(FIT_ROWS)
    fit = _matrix(sample.select("embedding").toArrow().column(0), size)
    half = (size + 1) // 2
    centroids = int(min(MAX_CENTROIDS, max(4, round((n / PER_CELL) ** 0.5))))
    one, two = fit_centroids(fit[:, :half], centroids), fit_centroids(fit[:, half:], centroids) if size > half else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), size)
                i, j = nearest_centroid(v[:, :half], one), nearest_centroid(v[:, half:], two)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["entry", "embedding", "ids", "i", "j"])

    indexed = materialise(entries.select("entry", "embedding", "ids").mapInArrow(assign, f"entry long, embedding {vector}, ids array<long>, i int, j int"), "index")
    counts = np.zeros((len(one), len(two)), np.int64)  # at most MAX_CENTROIDS^2 cells at any input size
    for r in indexed.groupBy("i", "j").count().collect():
        counts[r["i"], r["j"]] = r["count"]
    queries = materialise(asked.groupBy("embedding").agg(F.min("vec_id").alias("q")), "queries")
    n_queries, cores = queries.count(), spark.sparkContext.defaultParallelism
    deals = -(-n_queries // BLOCK)
    block = max(LEAST_BLOCK, min(BLOCK, n // (2 * cores)))
    # neighbouring lists share a group up to a block of entries; longer lists are dealt in several blocks
    per_list, group_of, filled, g = counts.sum(1), np.zeros(len(one), np.int64), 0, 0
    for i in range(len(one)):
        if filled and filled + per_list[i] > block:
            g, filled = g + 1, 0
        group_of[i] = g
        filled += per_list[i]
    blocks = [max(1, int(-(-per_list[group_of == x].sum() // block))) for x in range(g + 1)]
    wanted = max(4 * k, int(share * n))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, row, grp, part, reach = _matrix(b.column(1), size), [], [], [], []
            for r, x in enumerate(v):
                near_one, near_two = one @ x[:half], two @ x[half:]
                least = traverse(near_one, near_two, counts, wanted)
                least -= 1e-9 * (1 + abs(least))
                for c in np.unique(group_of[near_one + near_two.max() >= least]).tolist():
                    row += [r] * blocks[c]
                    grp += [c] * blocks[c]
                    part += range(blocks[c])
                    reach += [least] * blocks[c]
            if row:
                yield pa.RecordBatch.from_arrays([*(b.column(t).take(pa.array(row)) for t in (0, 1)), pa.array(reach, pa.float64()), pa.array(grp, pa.int32()), pa.array(part, pa.int32())], ["q", "embedding", "reach", "grp", "block"])

    probes = queries.select("q", "embedding").repartition(max(1, min(cores, n_queries // 64)), "q").mapInArrow(probe, f"q long, embedding {vector}, reach double, grp int, block int")
    probes = probes.withColumn("deal", F.pmod(F.xxhash64("q"), F.lit(deals)).cast("int"))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    dealt = indexed.withColumn("grp", pick(group_of.tolist(), F.col("i")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("entry"), pick(blocks, F.col("grp"))).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found_q, found_score, found_at = [], [], []
        if left.num_rows and right.num_rows:
            q, least = left.column("q").to_numpy(), left.column("reach").to_numpy()
            qv, ev = _matrix(left.column("embedding"), size), _matrix(right.column("embedding"), size)
            i, j, first = (right.column(c).to_numpy() for c in ("i", "j", "entry"))
            for start in range(0, len(q), AT_ONCE):
                x = qv[start : start + AT_ONCE]
                cells = (x[:, :half] @ one.T)[:, i] + (x[:, half:] @ two.T)[:, j]
                rough = np.where(cells >= least[start : start + AT_ONCE, None], x @ ev.T, -np.inf)
                edge = np.partition(rough, max(0, rough.shape[1] - k - 1), axis=1)[:, max(0, rough.shape[1] - k - 1)]
                for r in range(len(x)):  # what may be among the first, rounding aside
                    limit = edge[r] - 1e-9 * (1 + abs(edge[r])) if np.isfinite(edge[r]) else -np.inf
                    take = np.flatnonzero((rough[r] >= limit) & (rough[r] > -np.inf))
                    score = np.zeros(len(take))
                    for d in range(size):  # term by term, so that equal vectors have equal scores wherever they stand
                        score += ev[take, d] * x[r, d]
                    best = np.lexsort((first[take], -score))[: k + 1]
                    found_q += [int(q[start + r])] * len(best)
                    found_score += score[best].tolist()
                    found_at += take[best].tolist()
        return pa.table({"q": pa.array(found_q, pa.int64()), "score": pa.array(found_score, pa.float64()), "ids": right.column("ids").take(pa.array(found_at, pa.int64()))})

    keys = ["grp", "block", "deal"]
    hits = probes.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(rerank, "q long, score double, ids array<long>")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = hits.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    found = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    # back to every asking row: rows with the same vector share the list and leave themselves out
    lists_of = materialise(queries.join(found, "q").select("embedding", "found"), "found")
    others = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(lists_of, "embedding")
    others = others.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op4_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
