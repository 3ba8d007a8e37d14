"""Vectorised word and shingle hashes of whole texts, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in pieces of about this many bytes, so that a batch of long texts needs little memory.
PIECE_BYTES = 1 << 20

_random = np.random.default_rng(20240607)
#: A random value for each byte at each of 64 places; a word's hash is the sum over its bytes, from place 64 on times a random number for each 64 places.
_BYTES = _random.integers(1, 2**64, (64, 256), dtype=np.uint64)
_BYTES[:, ord("A") : ord("Z") + 1] = _BYTES[:, ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[:, _SPACE] = 0
_PLACES = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) and the number of words up to each text."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum(lengths)
    bounds = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    at = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    at[: starts[0]] = 0
    at[~word] = 0
    with np.errstate(over="ignore"):
        values = _BYTES.ravel()[((at & 63) << 8) | data]
        far = np.flatnonzero(at > 63)
        values[far] *= mix(at[far].astype(np.uint64) >> np.uint64(6), 5) | np.uint64(1)
        hashes = np.add.reduceat(values, starts)
    return mix(hashes), bounds


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of its whole sequence where it has fewer words; none without words."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = 0
    while first < len(raw):
        last, total = first, 0
        while last < len(raw) and (last == first or total + len(raw[last]) <= PIECE_BYTES):
            total += len(raw[last])
            last += 1
        words, bounds = word_hashes(raw[first:last])
        with np.errstate(over="ignore"):
            grams = sum((words[j : len(words) - k + 1 + j] * _PLACES[j] for j in range(k)), np.zeros(max(len(words) - k + 1, 0), np.uint64)) if len(words) >= k else words[:0]
            grams = mix(grams, k)
            begin = 0
            for end in bounds.tolist():
                n = end - begin
                if n >= k:
                    yield np.unique(grams[begin : end - k + 1])
                elif n:
                    whole = np.sum(words[begin:end] * _PLACES[:n], dtype=np.uint64)
                    yield mix(np.array([whole], np.uint64), 1000 + n)
                else:
                    yield words[:0]
                begin = end
        first = last
