"""Word hashes of whole texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed at once; longer texts are cut at a separator before that.
PIECE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_", *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end > at and _IS_WORD[data[end]]:
            end -= 1
        end = end if end > at else at + PIECE  # a word as long as that is cut
        yield data[at:end]
        at = end
    yield data[at:]


def _hash_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer, and where they start."""
    if not _powers:
        with np.errstate(over="ignore"):
            _powers.extend(np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE + 4096, p, np.uint64))]) for p in (_P, _INV))
    a = np.frombuffer(buf, np.uint8)
    w = np.concatenate([[False], _IS_WORD[a], [False]])
    edges = np.flatnonzero(w[1:] != w[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(a)])])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For stretches of the texts: number of the first, 64-bit hashes of their words, and offsets (one more than texts).

    Words are runs of ASCII letters, digits, underscores and any other than ASCII characters of the lower-cased text;
    the rest of ASCII separates. Null and empty texts have no words. Texts are whole; a stretch is at most PIECE bytes
    of text, or one longer text.
    """
    first, held, size = 0, [], 0

    def flush():
        lengths = np.array([len(b) + 1 for b in held])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        hashes, starts = _hash_words(b"\n".join(held))
        return first, hashes, np.searchsorted(starts, begin)

    for i, t in enumerate(texts):
        data = _bytes(t)
        if size + len(data) + 1 > PIECE and held:
            yield flush()
            first, held, size = i, [], 0
        if len(data) > PIECE:
            hashes = np.concatenate([_hash_words(p)[0] for p in _pieces(data)])
            yield i, hashes, np.array([0, len(hashes)])
            first = i + 1
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield flush()


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words that stay within a text, and their offsets; a text with fewer words has one shingle of all."""
    n = np.diff(offsets)
    rolled = np.zeros(len(hashes), np.uint64)
    for j in range(k):
        part = np.zeros(len(hashes), np.uint64)
        part[: max(0, len(hashes) - j)] = hashes[j:]
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + part
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.cumsum(count)
    # position of each kept shingle: text offset plus its number within the text
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(offsets[:-1], count)
    keep = mix(rolled[at]) if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for x in hashes[offsets[i] : offsets[i + 1]]:
                h = h * np.uint64(0xD6E8FEB86659FD93) + x
        keep[ends[i] - count[i]] = mix(np.array([h], np.uint64))[0]
    return keep, np.concatenate([[0], ends])
