"""Words of texts as arrays of hashes: what tasks share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Bytes of text that are taken up together within a task.
CHUNK_BYTES = 2 << 20

#: Entries after which a task forgets the words it has hashed.
CACHE_WORDS = 1 << 19

_MULTIPLIERS = np.random.default_rng(0x7EA).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """XXH64 of words, remembered within bounds."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishes sums of products, in place: the low bits of these know only low bits."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def rolling(h: np.ndarray, k: int, start: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` items of ``h``; none if ``h`` is shorter.  ``start`` picks other multipliers."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _MULTIPLIERS[(start + j) % 256]
    return mixed(out)


def sliding(h: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """The least (or by ``f``, greatest) of every window of ``w`` items, by doubling."""
    out, have = h, 1
    while have < w and len(h) >= w:
        step = min(have, w - have)
        out = f(out[:-step], out[step:])
        have += step
    return out if len(h) >= w else h[:0]


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Texts as UTF-8, in order, some at a time: at most ``limit`` bytes, or one text.  Null is empty."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode() if text is not None else b""
        if held and size + len(data) > limit:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that hold in ``mask``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]
