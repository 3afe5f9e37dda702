"""Hashing words and characters of whole batches of texts in numpy.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR;
A-Z count as a-z. One pass over the bytes of a batch gives a 64-bit hash of
every word, without a Python object for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACE = _rng.randint(1, 2**63 - 1, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes hashed at once (some 40 bytes of a worker's memory each); one longer text is hashed on its own.
BLOCK_BYTES = 250_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 65_536)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts, lower-cased in A-Z, of about ``limit`` bytes."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def hash_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``raw`` in order, and offsets: the words of text i
    are ``hashes[offsets[i]:offsets[i + 1]]``."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    text_ends = np.cumsum(lengths)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(data))
    running = np.empty(len(data) + 1, np.uint64)
    running[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=running[1:])
    hashes = mix64((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.zeros(len(raw) + 1, np.int64)
    offsets[1:] = np.searchsorted(starts, text_ends)
    return hashes, offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct ``width``-word shingle hashes.

    A text with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    n = len(hashes)
    if n >= width:
        windows = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            windows += hashes[k : n - width + 1 + k] * _PLACE[k]
        windows = mix64(windows)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            part = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    part += hashes[a + k] * _PLACE[k]
                part += np.uint64(b - a) * _PLACE[63]
            out.append(mix64(np.array([part], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
