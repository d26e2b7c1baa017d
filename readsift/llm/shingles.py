"""Words and word shingles as 64-bit numbers, computed for a whole Arrow batch of texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(_BASE)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes hashed in one go; the scratch arrays take about 30 times as much.
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_WHITE = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _TURN
        return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)


# A word's bytes are the digits of a number to an odd base; dividing by the power of its first place,
# which has an inverse, makes the number the same wherever the word stands.
_UP = _powers(_BASE, SLICE + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SLICE + 1)
_DIGIT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def _slice_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of at most ``SLICE`` bytes."""
    codes = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[codes], prepend=True, append=True))
    first, end = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_DIGIT[codes] * _UP[: len(codes)], dtype=np.uint64)])
        return mix((sums[end] - sums[first]) * _DOWN[first] + (end - first).astype(np.uint64)), first


def _word_hash(raw: bytes, first: int, end: int) -> np.ndarray:
    """Hash of one word of any length, its digits summed slice by slice."""
    total, power = 0, 1
    with np.errstate(over="ignore"):
        for at in range(first, end, SLICE):
            codes = np.frombuffer(raw, np.uint8, min(SLICE, end - at), at)
            total += power * int(np.sum(_DIGIT[codes] * _UP[: len(codes)], dtype=np.uint64))
            power = power * pow(_BASE, len(codes), 1 << 64) % (1 << 64)
    return mix(np.array([(total + end - first) % (1 << 64)], np.uint64))


def _long_hashes(raw: bytes) -> np.ndarray:
    """Word hashes of one long text, slice by slice, cut after white space. A word longer than a slice goes by itself."""
    found, at = [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        if end < len(raw):
            space = max(raw.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if space < 0:
                after = _WHITE.search(raw, end)
                end = after.start() if after else len(raw)
                found.append(_word_hash(raw, at, end))
                at = end
                continue
            end = space + 1
        found.append(_slice_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and the border of each text's (one more than texts)."""
    parts, sizes, waiting, held = [], [], [], 0

    def flush() -> None:
        nonlocal waiting, held
        if waiting:
            hashes, first = _slice_hashes(b"\n".join(waiting))
            ends = np.cumsum([len(w) + 1 for w in waiting])
            sizes.extend(np.diff(np.searchsorted(first, ends), prepend=0).tolist())
            parts.append(hashes)
        waiting, held = [], 0

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
        if held + len(raw) + 1 > SLICE:
            flush()
        if len(raw) >= SLICE:
            parts.append(_long_hashes(raw))
            sizes.append(len(parts[-1]))
        else:
            waiting.append(raw)
            held += len(raw) + 1
    flush()
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words in a row."""
    total = np.full(max(len(hashes) - size + 1, 0), size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size if len(total) else 0):
            total = mix(total * _ODD + hashes[i : i + len(total)])
    return total


def shingle_sets(texts: Iterable[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: a text of fewer words is one shingle, one of none has none."""
    hashes, borders = word_hashes(texts)
    runs = rolling(hashes, size)
    sets = []
    for first, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if end - first >= size:
            own = np.sort(runs[first : end - size + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            sets.append(own[fresh])
        else:
            sets.append(rolling(hashes[first:end], end - first) if end > first else hashes[:0])
    return sets
