"""NumPy kernels over packed UTF-8 text, used inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that one NumPy pass works on; a single longer text is one pass of its own.
CHUNK = 1 << 21
#: Bytes whose word hashes are made at once.
BLOCK = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def chunked(raws: Sequence[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about limit bytes together."""
    start = size = 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > limit:
            yield start, i
            start, size = i, 0
        size += len(raw) + 1
    if start < len(raws):
        yield start, len(raws)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end) of codes; ranges in order, without overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(BYTE[codes[lo:hi]] * up, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * BASE)
        i = j
    return out


def word_table(raws: Sequence[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, lower-cased in A-Z: (buffer, starts, ends, bounds); words of text i are bounds[i]:bounds[i + 1]."""
    buf = LOWER[np.frombuffer(b" ".join(raws), dtype=np.uint8)]
    flag = np.zeros(len(buf) + 2, dtype=np.int8)
    flag[1:-1] = is_word[buf]
    edge = np.diff(flag)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
    return buf, starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, at each place where n follow (across texts, too)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = out * BASE + words[j : m + j]
    return mix(out + np.uint64(n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of that width."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])
