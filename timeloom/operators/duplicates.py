"""Links between a video's candidates, found video by video in the task that reads them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from timeloom.plans.scratch import materialise, small_batches

#: Candidates and bytes of text of a video that a task holds at most; larger videos are left to joins.
MAX_ROWS, MAX_BYTES = 8192, 32_000_000
#: Bits that a candidate's tokens fall on (more where they have many, up to so many for a video), rows that are compared at once, and what
#: rounding may take from a bound.
WIDTH, MAX_BITS, BLOCK, SLACK = 512, 1 << 24, 64, 1e-9
#: The bytes of tokens as they come, the other bytes, and a table of all bytes: lower case in a token, 1 at a sentence's end, else 0.
_INSIDE = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'"
_OUTSIDE = bytes(c for c in range(256) if c not in _INSIDE)
_KIND = bytes(c + 32 if 65 <= c <= 90 else c if c in _INSIDE else int(c in b".?!") for c in range(256))


def numbered(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of texts as numbers: where each text's begin (and the end of the last), the numbers, and whether the first
    sentence has them. Letters a to z, digits and apostrophes in lower case, as ``C.tokens`` has them."""
    text = text.fill_null("").cast(pa.large_string())
    held = text.buffers()[2].to_pybytes() if text.buffers()[2] else b""
    if b"\xc4\xb0" in held or b"\xe2\x84\xaa" in held:  # the only other letters whose lower case has a letter of a to z
        text = pa.array([t.lower() for t in text.to_pylist()], pa.large_string())
        held = text.buffers()[2].to_pybytes()
    begin = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    held, begin = held[begin[0] : begin[-1]], begin - begin[0]
    kind = np.frombuffer(held.translate(_KIND), np.uint8)
    inside = kind > 1
    # a token goes from where it begins, or a text does, to where it ends, or its text does
    turns = inside[1:] != inside[:-1]
    turns[begin[(begin > 0) & (begin < len(held))] - 1] = True
    turns = np.concatenate(([0], np.flatnonzero(turns) + 1, [len(held)])) if held else np.zeros(1, np.int64)
    runs = np.flatnonzero(inside[turns[:-1]])
    at, ends = turns[runs], np.flatnonzero(kind == 1)
    count = np.diff(np.searchsorted(at, begin))
    sentence = np.append(ends, len(held))[np.searchsorted(ends, begin[:-1])]
    offsets = np.append(0, np.cumsum(turns[runs + 1] - at))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held.translate(_KIND, _OUTSIDE))).dictionary_encode()
    n, most = len(text), max(1, len(words.dictionary))
    key = np.repeat(np.arange(n), count) * most + words.indices.to_numpy().astype(np.int64)
    key = np.sort(key * 2 + (at >= np.repeat(sentence, count)))
    key = key[np.append(True, key[1:] >> 1 != key[:-1] >> 1)] if len(key) else key
    return np.searchsorted(key >> 1, np.arange(n + 1) * most), (key >> 1) % most, key & 1 == 0


def components(video: np.ndarray, cand: np.ndarray, known: np.ndarray, topic: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray, ids: np.ndarray, hook: np.ndarray) -> np.ndarray:
    """For each candidate, sorted by video and ``cand``, the place of the smallest one of its video that duplicates (as in ``duplicate_pairs``)
    link it to, or -1 where it has none. Only ``known`` ones are compared; a negative topic is none; tokens as from ``numbered``.

    Tokens fall on bits; the bits that two candidates have in common, and the tokens that share a bit with another of their own, bound what
    they can share. Pairs that this leaves and that aren't linked yet are compared exactly, so a large group of copies takes about as many
    comparisons as it has members."""
    n = len(cand)
    fresh = np.append(True, (cand[1:] != cand[:-1]) | (video[1:] != video[:-1]))
    node = np.cumsum(fresh) - 1  # rows of one candidate are one node, told by its first row
    row = np.flatnonzero(fresh)
    size, width = np.diff(begin), WIDTH
    while n * width < 6 * size.sum() and n * width * 2 <= MAX_BITS:
        width *= 2
    bits = np.zeros(n * width, np.float32)
    bits[np.repeat(np.arange(n) * width, size) + ids[begin[0] : begin[-1]] % width] = 1
    bits = bits.reshape(n, width)
    total = size.astype(np.float32)
    doubled = total - bits.sum(1)
    said = np.append(0, np.cumsum(hook[begin[0] : begin[-1]]))[begin - begin[0]]
    said = said[1:] > said[:-1]
    several = bool(video[0] != video[-1])
    of, at, parent = topic.tolist(), node.tolist(), list(range(len(row)))
    sets: dict[int, set[int]] = {}

    def held(i: int) -> set[int]:
        if i not in sets:
            sets[i] = set(ids[begin[i] : begin[i + 1]].tolist())
        return sets[i]

    def first(i: int) -> set[int]:
        own = np.s_[begin[i] : begin[i + 1]]
        return set(ids[own][hook[own]].tolist())

    def jaccard(x: set[int], y: set[int]) -> float:
        both = len(x & y)
        return both / (len(x) + len(y) - both) if x or y else 0.0

    def alike(i: int, j: int, iou: float) -> bool:
        jac = jaccard(held(i), held(j))
        return iou >= 0.70 or jac >= 0.65 or of[i] >= 0 and of[j] >= 0 and jac * 0.40 + iou * 0.30 + float(of[i] == of[j]) * 0.15 + jaccard(first(i), first(j)) * 0.15 >= 0.50

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for lo in range(0, n, BLOCK):
        a, b = np.s_[lo : lo + BLOCK, None], np.s_[None, lo:]
        # half of the vocabulary, or common time: a duplicate without it has that; then all signs of the pairs that are left
        most = bits[lo : lo + BLOCK] @ bits[lo:].T
        most += np.minimum(doubled[a], doubled[b])
        may = most * 3 >= total[a] + total[b]
        may |= (start[a] < end[b]) & (start[b] < end[a])
        if several:
            may &= video[a] == video[b]
        i, j = np.nonzero(may)
        most, i, j = most[i, j].astype(float), i + lo, j + lo
        jac = most / np.maximum(size[i] + size[j] - most, 1)
        cut = np.maximum(0, np.minimum(end[i], end[j]) - np.maximum(start[i], start[j]))
        iou = cut / np.maximum(100, end[i] - start[i] + end[j] - start[j] - cut)
        whole = jac * 0.40 + iou * 0.30 + (topic[i] == topic[j]) * 0.15 + (said[i] & said[j]) * 0.15
        left = np.flatnonzero(((iou >= 0.70) | (jac >= 0.65 - SLACK) | (whole >= 0.50 - SLACK)) & known[i] & known[j] & (node[i] < node[j]))
        for x, y, share in zip(i[left].tolist(), j[left].tolist(), iou[left].tolist()):
            p, q = at[x], at[y]
            if parent[p] != parent[q] and (p := root(p)) != (q := root(q)) and alike(x, y, share):
                parent[max(p, q)] = min(p, q)
    least = np.array([root(k) for k in range(len(row))])
    many = np.bincount(least) > 1
    least = least[node]
    return np.where(many[least] & known, row[least], -1)


def linked_in_tasks(candidates: DataFrame) -> DataFrame:
    """Add ``component`` (the smallest candidate of ``components``; null also where ``video_id`` or ``cand`` is null) and ``late``: the video is larger than
    MAX_ROWS or MAX_BYTES, so its components aren't known and its candidates keep their ``text``, which is null otherwise. The result is written.

    Spark sorts by video and marks each first row; a task reads its videos in shared batches. What is held is a batch and the video
    that it ends in, up to those limits; then that video's rows are passed on as they come."""
    names = [c for c in candidates.columns if c != "text"]
    most_rows, most_bytes = MAX_ROWS, MAX_BYTES

    def out(t: pa.Table, component: pa.Array | None) -> list[pa.RecordBatch]:
        late = component is None
        text = t.column("text").cast(pa.string()) if late else pa.nulls(t.num_rows, pa.string())
        component = pa.nulls(t.num_rows, pa.int64()) if late else component
        return t.select(names).append_column("component", component).append_column("late", pa.array([late] * t.num_rows, pa.bool_())).append_column("text", text).combine_chunks().to_batches()

    def done(t: pa.Table, firsts: list[int]) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        known, timed = (np.logical_and(*(t.column(c).is_valid().to_numpy() for c in pair)) for pair in (("video_id", "cand"), ("start_ms", "end_ms")))
        cand, start, end = (t.column(c).fill_null(0).to_numpy() for c in ("cand", "start_ms", "end_ms"))
        start, end = np.where(timed, start, 0), np.where(timed, end, 0)
        topic = pc.index_in(t.column("topic_id"), t.column("topic_id").unique().drop_null()).fill_null(-1).to_numpy()
        topic = np.where(timed, topic, -1)  # without a time, nothing but the vocabulary counts
        begin, ids, hook = numbered(pa.concat_arrays(t.column("text").chunks))
        video = np.zeros(t.num_rows, np.int64)
        video[firsts] = 1
        video = np.cumsum(video)
        # small videos share a block, as one of their own takes longer than their comparisons
        cuts = [0]
        for lo, hi in zip(firsts, [*firsts[1:], t.num_rows]):
            if hi - cuts[-1] > BLOCK and lo > cuts[-1]:
                cuts.append(lo)
        found = []
        for lo, hi in zip(cuts, [*cuts[1:], t.num_rows]):
            own = np.s_[lo:hi]
            of = components(video[own], cand[own], known[own], topic[own], start[own], end[own], begin[lo : hi + 1], ids, hook)
            found.append(np.where(of < 0, -1, of + lo))
        found = np.concatenate(found)
        return out(t, pa.array(cand[found].astype(np.int64), pa.int64(), mask=found < 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        late = False
        for b in batches:
            t = pa.Table.from_batches([b])
            if late:
                first = np.flatnonzero(t.column("_nth").to_numpy() == 1)
                cut = int(first[0]) if len(first) else t.num_rows
                yield from out(t.slice(0, cut), None)
                t, late = t.slice(cut), not len(first)
            if held is not None:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            firsts = np.flatnonzero(t.column("_nth").to_numpy() == 1).tolist()
            if firsts[-1]:
                yield from done(t.slice(0, firsts[-1]), firsts[:-1])
            held = t.slice(firsts[-1])
            if held.num_rows > most_rows or (pc.sum(pc.binary_length(held.column("text"))).as_py() or 0) > most_bytes:
                yield from out(held, None)
                held, late = None, True
        if held is not None:
            yield from done(held, [0])

    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("cand"))
    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in names)
    with small_batches(candidates.sparkSession):
        return materialise(candidates.withColumn("_nth", nth).mapInArrow(run, f"{kinds}, component long, late boolean, text string"), "linked")
