"""Two tokenizers' tokens of the same bytes, linked, and how many documents hold each link."""

from __future__ import annotations

import gc
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import NamedTuple
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from timeloom.llm.sums import summed
from timeloom.llm.words import mix
from timeloom.plans.scratch import materialise

SPACE = "▁"
#: Chunks whose alignment a worker keeps, characters of a chunk that is kept at most, documents and characters that are aligned at once.
REMEMBERED, KEPT_LENGTH, AT_ONCE, AT_ONCE_CHARS = 200_000, 64, 1024, 4_000_000
#: What the byte-level model's library cuts texts by before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that any library's tables class alike; other chunks go to the model's own library.
_SETTLED = re.compile("[ -~\n\u00c0-\u024f]*").fullmatch
#: Chunks that may follow each other in any order; blanks at which a text is cut, and what shows one that isn't such.
_JOINED = re.compile("[ \n][!-~\u00c0-\u024f]+").fullmatch
_BLANK, _ODD = re.compile(r"(?<=[!-~\w]) "), re.compile(r" (?<=[^!-~\w] )|^ ").search
#: Pairs that a task counts before it sends them on, pairs of a hash table at most, and of a part of one that is built in one task about.
TALLY, MAX_PAIRS, SHARD = 1_000_000, 4_000_000, 65_536
#: Tokens that are looked up at once about.
LOOKED_UP = 200_000
#: Bits a pair at each level of the hash, and levels at most.
SPARE, LEVELS = 2, 200


def byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


#: What stands behind a token by its mark.
MARKS = ",|,;"


def id_type(width: int) -> np.dtype:
    """Unsigned whole numbers of so many bytes, the lowest first."""
    return np.dtype(f"<u{max(2, width)}")


class Aligned(NamedTuple):
    """Tokens of a chunk, group by group, those of A before those of B: ids as bytes of unsigned numbers, a mark for each (0 and 1 for
    A, 2 and 3 for B, the odd one where it ends its side of a group), and a key for each link, as bytes of 64-bit numbers."""

    tokens: bytes
    marks: bytes
    links: bytes

    @property
    def groups(self) -> str:
        """The groups as text, each with ``;`` behind."""
        ids = np.frombuffer(self.tokens, id_type(len(self.tokens) // max(1, len(self.marks))))
        return "".join([f"{i}{MARKS[m]}" for i, m in zip(ids.tolist(), self.marks)])


def overlapping(ends_a: np.ndarray, size_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the first token of B that shares a byte with it, and how many do: from the one that holds its first byte to
    the one that holds its last. Ends count bytes from one place."""
    begin = np.searchsorted(ends_b, ends_a - size_a, "right")
    return begin, np.searchsorted(ends_b, ends_a, "left") + 1 - begin


def link_keys(a: np.ndarray, b: np.ndarray, begin: np.ndarray, n_links: np.ndarray, width: int) -> np.ndarray:
    """A key for each link, in the order of A's tokens."""
    through = np.cumsum(n_links)
    other = np.arange(through[-1] if len(through) else 0) - np.repeat(through - n_links - begin, n_links)
    return np.repeat(a, n_links) * width + b[other]


#: A worker's aligners, whose tables are let go when it does other work.
MADE: WeakSet = WeakSet()


class Aligner:
    """Tokens of both models for texts, chunk by chunk.

    A chunk ends before a blank or line feed that follows a visible character, and between an ASCII letter and a mark
    such as a full stop. Parts between such blanks are looked up first, chunks only for new parts. Proved from the files before any text is read: the byte-level model's pattern never takes a
    visible character together with white space after it, nor letters with marks; no piece of the other model has a blank after
    another character, a line feed beside any, or such a letter and mark side by side. So tokens never cross those places, and equal chunks have equal tokens. Models
    for which that can't be proved have each text as one chunk.

    Where every vocabulary entry of A encodes alone as itself, and entries are numbered in the order of their merges, merging the
    pair whose joined bytes have the lowest number is the same as following the list of merges: a pair of
    tokens that join to an entry by another merge than the entry's own would be left over in the entry's own encoding too.
    Then ``tiktoken`` does the merging, which takes half the time.
    """

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine's cores already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.width = len(pieces)
        n = max(self.a_bytes, default=-1) + 1
        self.a_size, self.b_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(n)], np.int64), np.array(list(map(len, self.b_bytes)), np.int64)
        self.kind = id_type(2 if max(n, len(pieces)) <= 1 << 16 else 4)
        self.split = self._cuts(json.loads(self.a.to_str()), [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))])
        self.lead = self.b.encode("\n", num_threads=1)
        self.quick = self._merger(json.loads(self.a.to_str())["model"]) if self.split else None
        #: Two generations: when the younger is full it becomes the older, from which what is used again is taken over.
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}
        self.pieces: dict[str, Aligned | None] = {}
        self.long: list[str] = []
        MADE.add(self)

    def _merger(self, model: dict):
        """Encoding of one chunk by ``tiktoken``; None where it can't be proved the same."""
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if model.get("ignore_merges") or any(vocab["".join(m)] != 256 + n for n, m in enumerate(merges)) or len(self.a_bytes) < 256 + len(merges):
            return None
        if any([t.id for t in self.a.model.tokenize("".join(m))] != [256 + n] for n, m in enumerate(merges)):
            return None
        import tiktoken

        ranks = {t: i for i, t in self.a_bytes.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _cuts(self, a: dict, pieces: list[str]):
        """What splits a text into chunks; None where the proof fails."""
        first = a["pre_tokenizer"] or {}
        if a["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex"):
            return None
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p and len(p) > 1 for p in pieces):
            return None
        if self.b.encode("\n", out_type=str) != [SPACE, "<0x0A>"] or self.b.encode("\n  a", out_type=str)[:2] != [SPACE, "<0x0A>"] or self.b.normalize("ﬁ  ① é ") != SPACE + "ﬁ  ① é ".replace(" ", SPACE):
            return None
        cut = r"(?<=[!-~\w])(?=[ \n])"
        if not any(re.search("[A-Za-z][.,;:!?]", p) for p in pieces):
            cut += r"|(?<=[A-Za-z])(?=[.,;:!?])"
        return re.compile(cut).split

    def parts(self, text: str) -> list[str]:
        """A text cut at blanks where chunks may end; each part stands for a blank and itself."""
        if not self.split:
            return [text]
        return _BLANK.split(text) if _ODD(text) else text.split(" ")

    def _encoded(self, chunks: list[str]) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The chunks in another order, their bytes, all tokens of A and of B, and how many each chunk has.

        Chunks that may stand side by side in a text are encoded as one text; its tokens are dealt to chunks by their bytes.
        """
        joined = [c for c in chunks if _JOINED(c)] if self.quick else []
        single = list(set(chunks).difference(joined)) if joined else chunks
        settled = [c for c in single if self.quick and _SETTLED(c)]
        single = settled + ([c for c in single if not _SETTLED(c)] if self.quick else single)
        of_a = [self.quick(c) for c in settled] + ([e.ids for e in self.a.encode_batch_fast(single[len(settled) :], add_special_tokens=False)] if len(single) > len(settled) else [])
        if self.split:  # a line feed before keeps the model's own blank away
            of_b = [ids[len(self.lead) :] for ids in self.b.encode(["\n" + c for c in single], num_threads=1)] if single else []
        else:
            of_b = self.b.encode([c[1:] for c in single], num_threads=1)
        data = [c.encode("utf-8", "surrogatepass") for c in joined]
        until = np.cumsum([0, *map(len, data)])
        out = []
        for ids, of, size in ((self.quick("".join(joined)) if joined else [], of_a, self.a_size), (self.b.encode("\n" + "".join(joined), num_threads=1)[len(self.lead) :] if joined else [], of_b, self.b_size)):
            ids = np.array(ids, np.int64)
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            at = np.searchsorted(ends, until)
            if len(ends) <= at[-1] or not np.array_equal(ends[at], until):
                raise ValueError("tokens cross the ends of chunks")
            out.append((np.concatenate([ids, np.fromiter(chain.from_iterable(of), np.int64)]), np.concatenate([np.diff(at), np.fromiter(map(len, of), np.int64, len(of))])))
        (a, n_a), (b, n_b) = out
        return joined + single, data + [c.encode("utf-8", "surrogatepass") for c in single], a, b, n_a, n_b

    def _aligned(self, data: list[bytes], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[Aligned | None]:
        """All chunks at once; None where the tokens' bytes differ from the chunk's."""
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        until = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        last = lambda ends, n: np.concatenate([[0], ends])[np.cumsum(n)]
        whole = b"".join(data)
        if not (np.array_equal(last(ends_a, n_a), until) and np.array_equal(last(ends_b, n_b), until) and b"".join([self.a_bytes[t] for t in a.tolist()]) == whole and b"".join([self.b_bytes[t] for t in b.tolist()]) == whole):
            same = lambda d, x, y: b"".join([self.a_bytes.get(t, b"") for t in x]) == d == b"".join([self.b_bytes[t] for t in y])
            right = [same(d, a[i : i + n].tolist(), b[j : j + m].tolist()) for d, i, n, j, m in zip(data, first_a, n_a, first_b, n_b)]
            r = np.array(right)
            good = iter(self._aligned([d for d, ok in zip(data, right) if ok], a[np.repeat(r, n_a)], b[np.repeat(r, n_b)], n_a[r], n_b[r]))
            return [next(good) if ok else None for ok in right]
        # tokens that end where one of the other model does close a group
        close_a, close_b = (np.isin(x, y, assume_unique=True) for x, y in ((ends_a, ends_b), (ends_b, ends_a)))
        begin, n_links = overlapping(ends_a, self.a_size[a], ends_b)
        through = np.cumsum(n_links)
        links = link_keys(a, b, begin, n_links, self.width).tobytes()
        of_chunk = 8 * np.concatenate([[0], through])
        # token by token: those of A before those of B in each group
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        before_a = np.concatenate([[0], np.flatnonzero(close_b) + 1])  # tokens of B before each group
        before_b = np.flatnonzero(close_a) + 1  # tokens of A up to each group's end
        at_a, at_b = np.arange(len(a)) + before_a[group_a], np.arange(len(b)) + before_b[group_b]
        tokens, marks = np.empty(len(a) + len(b), self.kind), np.empty(len(a) + len(b), np.uint8)
        tokens[at_a], tokens[at_b], marks[at_a], marks[at_b] = a, b, close_a, 2 + close_b
        tokens, marks, wide = tokens.tobytes(), marks.tobytes(), self.kind.itemsize
        first, n = first_a + first_b, n_a + n_b
        return [Aligned(tokens[wide * i : wide * (i + k)], marks[i : i + k], links[x:y]) for i, k, x, y in zip(first.tolist(), n.tolist(), of_chunk[first_a].tolist(), of_chunk[first_a + n_a].tolist())]

    def _chunks_of(self, chunks: list[str]) -> dict[str, Aligned | None]:
        new = [c for c in set(chunks) if c not in self.pieces]
        if new:
            if len(self.pieces) > REMEMBERED:
                self.pieces, new = {}, list(set(chunks))
            order, data, *tokens = self._encoded(new)
            self.pieces.update(zip(order, self._aligned(data, *tokens)))
        return self.pieces

    def align(self, texts: list[str]) -> tuple[list[list[str]], set[str], dict[str, Aligned | None]]:
        """The texts' parts, all of them as a set, and a table that holds the alignment of each (and of others)."""
        gc.disable()  # what is made here holds no cycles, and the collector would walk all that is kept again and again
        cut = [self.parts(t) for t in texts]
        for p in self.long:  # held for one call only
            self.known.pop(p, None)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, wanted = self.known, self.older, set().union(*cut)
        fresh = wanted.difference(known)
        known.update((p, older[p]) for p in fresh if p in older)
        new = list(fresh.difference(older))
        chunks = [self.split(" " + p) if self.split else [" " + p] for p in new]
        of = self._chunks_of(list(chain.from_iterable(chunks)))
        for p, own in zip(new, chunks):
            if len(own) == 1:
                known[p] = of[own[0]]
                continue
            each = [of[c] for c in own]
            if None in each:
                known[p] = None
            else:
                tokens, marks, links = zip(*each)
                known[p] = Aligned(b"".join(tokens), b"".join(marks), b"".join(links))
        self.long = [p for p in new if len(p) > KEPT_LENGTH]
        if any(len(p) > 4 * KEPT_LENGTH for p in self.long):
            self.pieces = {}
        gc.freeze()
        gc.enable()
        return cut, wanted, known


@lru_cache(maxsize=2)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def forget() -> None:
    """Let go of what this worker's aligners keep."""
    for of in MADE:
        of.known, of.older, of.pieces, of.long = {}, {}, {}, []


def stretches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts, as many as are aligned at once, and the number of the first; null texts as empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if len(held) >= AT_ONCE or size >= AT_ONCE_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class MinimalHash:
    """A number from 0 on, without gaps, for each of a set of keys (distinct unsigned 64-bit numbers).

    Keys are dealt to parts by their hash, and each part is built on its own (``part_of``): at each level a key's bit is set if no
    other key left has the same, and the others go to the next level. A key's number is how many bits are set before its own, over all levels. A
    key that isn't in the set has any number, or none (-1): callers verify.
    """

    def __init__(self, parts: list[list[bytes]]):
        self.parts = len(parts)
        self.levels, base = [], 0
        for level in range(max((len(p) for p in parts), default=0)):
            words = [np.frombuffer(p[level], np.uint64) if level < len(p) else np.zeros(0, np.uint64) for p in parts]
            size = np.array([len(w) * 64 for w in words], np.uint64)
            start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64)
            every = np.concatenate(words)
            before = base + np.concatenate([[0], np.cumsum(np.bitwise_count(every).astype(np.int64))])
            base = int(before[-1])
            self.levels.append((every, before[:-1], start, size))
        self.n = base

    @staticmethod
    def part(keys: np.ndarray, parts: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(max(1, parts))).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))

    @classmethod
    def part_of(cls, keys: np.ndarray) -> list[bytes]:
        """The levels of a part with these distinct keys, as bits in 64-bit words."""
        left, out = keys.astype(np.uint64), []
        while len(left):
            if len(out) == LEVELS:
                raise ValueError("keys must be distinct")
            words = -(-SPARE * len(left) // 64)
            at = cls._at(left, len(out)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            out.append(np.packbits(alone, bitorder="little").tobytes())
            left = left[~alone[at.astype(np.int64)]]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        part = self.part(keys, self.parts) if self.parts else np.zeros(len(keys), np.int64)
        for level, (words, before, start, size) in enumerate(self.levels):
            left = left[size[part[left]] > 0]
            if not len(left):
                break
            at = start[part[left]] + self._at(keys[left], level) % size[part[left]]
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word] >> bit
            hit = (held & np.uint64(1)).astype(bool)
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out


@dataclass
class PairCounts:
    """Documents by pair, for the pairs of a range of first ids: dense arrays in the order of the hash."""

    low: int
    high: int
    width: int
    hash: MinimalHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys of the range; a key that wasn't counted is an error."""
        at = self.hash(keys)
        if len(at) and ((at < 0).any() or (self.keys[at] != keys).any()):
            raise ValueError("a pair that wasn't counted: the documents have changed between the passes")
        return at


def _align(a_file: str, b_file: str, text: str, keep: list[str]):
    """A row for each document: the columns ``keep``, ids and marks of its tokens (null without any); and rows with a pair and how many of
    the task's documents hold it, whose other columns are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, kept = aligner(a_file, b_file), Counter(), []
        names = [*keep, "_tokens", "_marks", "_pair", "_n"]

        def sent() -> pa.RecordBatch:
            columns = [*(pa.nulls(len(counts), t) for t in (*kept, pa.binary(), pa.binary())), pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for whole in batches:
            own_columns = [whole.column(whole.schema.names.index(k)) for k in keep]
            kept = [c.type for c in own_columns]
            for first, texts in stretches(whole.column(whole.schema.names.index(text)).to_pylist()):
                cut, _, known = of.align(texts)
                tokens, marks, pairs = [], [], [np.zeros(0, np.int64)]
                for t, parts in zip(texts, cut):
                    own = [known[p] for p in parts]
                    if not t or None in own:
                        tokens.append(None)
                        marks.append(None)
                        continue
                    tokens.append(b"".join([v.tokens for v in own]))
                    marks.append(b"".join([v.marks for v in own]))
                    pairs.append(np.unique(np.frombuffer(b"".join([known[p].links for p in set(parts)]), np.int64)))
                held, n = np.unique(np.concatenate(pairs), return_counts=True)
                counts.update(dict(zip(held.tolist(), n.tolist())))
                found = [pa.array(tokens, pa.binary()), pa.array(marks, pa.binary()), pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in own_columns), *found], names)
                if len(counts) > TALLY:
                    yield sent()
                    counts = Counter()
        if counts:
            yield sent()

    return run


def pair_table(tallies: DataFrame, low: int, high: int, width: int) -> PairCounts:
    """The counts of the pairs whose first id is in ``low`` to ``high - 1``: at most MAX_PAIRS, which the caller sees to.

    Distinct pairs are dealt to parts of about SHARD by their hash, each part's levels are built in a task, and the tasks'
    counts are added as dense vectors by the finished hash, in two steps.
    """
    own = tallies.where((F.col("pair") >= low * width) & (F.col("pair") < high * width))
    distinct = materialise(own.select("pair").distinct(), "pairs")
    parts = max(1, distinct.count() // SHARD)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(MinimalHash.part(b.column(0).to_numpy(), parts), pa.int32())], ["pair", "part"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        pairs = np.sort(table.column("pair").to_numpy())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([MinimalHash.part_of(pairs)], pa.list_(pa.binary())), "pairs": pa.array([pairs.tobytes()], pa.binary())})

    built = distinct.mapInArrow(numbered, "pair long, part int").groupBy("part").applyInArrow(build, "part int, levels array<binary>, pairs binary").toArrow().to_pylist()
    of_part = {r["part"]: r for r in built}
    hashed = MinimalHash([of_part[p]["levels"] if p in of_part else [] for p in range(parts)])
    pairs = np.concatenate([np.frombuffer(r["pairs"], np.int64) for r in built]) if built else np.zeros(0, np.int64)
    keys = np.zeros(hashed.n, np.int64)
    keys[hashed(pairs)] = pairs
    table = PairCounts(low, high, width, hashed, keys, np.zeros(0), np.zeros(0))

    def dense(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        x = np.zeros(hashed.n)
        for b in batches:
            np.add.at(x, table.places(b.column(0).to_numpy()), b.column(1).to_numpy())
        return x

    table.counts = summed(own.select("pair", "n"), dense, hashed.n).astype(np.int64)
    most = np.zeros(high - low, np.int64)
    np.maximum.at(most, keys // width - low, table.counts)
    table.best = table.counts == most[keys // width - low]
    return table


_FOUND = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())]
_SUMS = ("n_best", "count_sum")


def _pieces_of(marks: pa.Array) -> Iterator[tuple[int, int]]:
    """First and number of neighbouring rows that are looked up at once."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(marks), 0).to_pylist()):
        held += n
        if held >= LOOKED_UP:
            yield first, i + 1 - first
            first, held = i + 1, 0
    if first < len(marks):
        yield first, len(marks) - first


def _look_up(size_a: np.ndarray, size_b: np.ndarray, table: PairCounts, keep: list[str], begin: bool, last: bool):
    """Add up the counts of the links between each row's tokens, those of the table's range; after other ranges (not ``begin``) their
    sums grow. With ``last`` the tokens become figures and text, else they stay for the next range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        low, high = table.low * table.width, table.high * table.width
        n = max(len(size_a), len(size_b))
        written = np.array([f"{i}{mark}" for mark in MARKS for i in range(n)], object) if last else None
        for whole in batches:
            for first, rows in _pieces_of(whole.column("_marks")):
                b = whole.slice(first, rows)
                tokens, marks = (b.column(k).to_pylist() for k in ("_tokens", "_marks"))
                of = np.array([len(m or b"") for m in marks], np.int64)
                mark = np.frombuffer(b"".join([m for m in marks if m]), np.uint8)
                data = b"".join([t for t in tokens if t])
                ids = np.frombuffer(data, id_type(len(data) // max(1, len(mark)))).astype(np.int64)
                ends = np.cumsum(of)
                of_a = mark < 2
                up_to = lambda x: np.concatenate([[0], np.cumsum(x)])
                by_row = lambda x, at=ends: np.diff(up_to(x)[np.concatenate([[0], at])])
                id_a, id_b = ids[of_a], ids[~of_a]
                n_a = by_row(of_a)
                from_b, n_links = overlapping(np.cumsum(size_a[id_a]), size_a[id_a], np.cumsum(size_b[id_b]))
                links = link_keys(id_a, id_b, from_b, n_links, table.width)
                of_links = by_row(n_links, np.cumsum(n_a))
                inside = slice(None) if not len(links) or (links.min() >= low and links.max() < high) else (links >= low) & (links < high)
                count, best = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
                at = table.places(links[inside])
                count[inside], best[inside] = table.counts[at], table.best[at]
                found = {k: by_row(x, np.cumsum(of_links)) for k, x in zip(_SUMS, (best, count))}
                if not begin:
                    found = {k: v + b.column(k).to_numpy() for k, v in found.items()}
                if last:
                    text = written[ids + mark.astype(np.int64) * n].tolist()
                    groups = ["".join(text[i:j])[:-1] for i, j in zip((ends - of).tolist(), ends.tolist())]
                    found |= {"n_a": n_a, "n_b": of - n_a, "n_groups": by_row(mark == 3), "n_links": of_links, "groups": groups}
                    names = keep + [k for k, _ in _FOUND]
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(found[k], t) for k, t in _FOUND)], names)
                else:
                    names = [*keep, "_tokens", "_marks"]
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *(pa.array(found[k], pa.int64()) for k in _SUMS)], [*names, *_SUMS])

    return run


def align_tokens(docs: DataFrame, a_file: str, b_file: str, text: str = "text", max_pairs: int = MAX_PAIRS, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` to documents by their whole ``text``.

    A (a ``tokenizers`` file with byte-level vocabulary) reads a blank and the text, B (a ``sentencepiece`` model that puts a blank before) the text. Places
    where tokens of both end cut them into ``groups`` (``a1,a2|b1;a3|b2,b3``); tokens whose bytes overlap are linked.
    ``count_sum`` adds, over links, how many documents hold a link of the same two ids; ``n_best`` counts the links
    whose ids' count is the highest of their A id, ties included. Null and empty texts, and texts that a model doesn't give
    back byte for byte, have no tokens: zeros and ''. Repeated rows are documents of their own; an empty table stays empty; other
    columns stay (those in ``keep``, if given), but for ones named like the results, which are replaced.

    Documents are aligned once: ids of their tokens are written, two bytes each with one for the groups, beside counts of
    documents by pair in each task. A second pass looks counts up. They are held in
    arrays that a minimal perfect hash of the distinct pairs indexes; their number is looked at first, and beyond ``max_pairs`` the
    second pass runs once for each range of A ids with at most so many (one A id has at most as many as B has ids). Both files must be
    readable on every executor.
    """
    docs = docs.drop(*(n for n, _ in _FOUND))
    keep = docs.columns if keep is None else keep
    of = aligner(a_file, b_file)
    types = lambda columns: [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in columns]
    aligned = docs.mapInArrow(_align(a_file, b_file, text, keep), ", ".join([*types(keep), "_tokens binary, _marks binary, _pair long, _n long"]))
    aligned = materialise(aligned, "aligned-tokens")
    tallies = aligned.where("_pair is not null").select(F.col("_pair").alias("pair"), F.col("_n").alias("n"))
    by_a = tallies.select("pair").distinct().groupBy(F.expr(f"pair div {of.width}").alias("a")).count().orderBy("a").toArrow()  # at most as many rows as A has ids
    ranges, low, held = [], 0, 0
    for a, n in zip(by_a.column("a").to_pylist(), by_a.column("count").to_pylist()):
        if held and held + n > max_pairs:
            ranges.append((low, a))
            low, held = a, 0
        held += n
    ranges.append((low, max([low, *by_a.column("a").to_pylist()]) + 1))
    out = aligned.where("_pair is null").select(*keep, "_tokens", "_marks")
    for i, (low, high) in enumerate(ranges):
        last = i + 1 == len(ranges)
        more = [f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _FOUND] if last else ["_tokens binary, _marks binary", *(f"{n} long" for n in _SUMS)]
        out = out.mapInArrow(_look_up(of.a_size, of.b_size, pair_table(tallies, low, high, of.width), keep, i == 0, last), ", ".join([*types(keep), *more]))
        if not last:
            out = materialise(out, "aligned")  # each range's table is held by the tasks of one pass only
    return out


def op12_pair_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
