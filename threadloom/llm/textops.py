"""Array kernels over batches of texts that several operators share.

Words are maximal runs of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text. A word is a 64-bit polynomial hash of its
UTF-8 bytes, mixed; the hash depends on the word alone, never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or _c == 95 or chr(_c).isalnum()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size, inverse = max(n, PIECE + 4096), pow(_MULT, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, _MULT, np.uint64)
            up[0] = 1
            down = np.full(size, inverse, np.uint64)
            down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (murmur3's constants), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix_int(x: int) -> int:
    """``mix`` for one Python integer."""
    return int(mix(np.array([int(x) & (2**64 - 1)], np.uint64))[0])


def slices(lengths: list[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` units, one text at least."""
    begin = total = 0
    for k, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and ``len(texts) + 1`` offsets into them."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    blob = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    flags = _WORD[blob]
    hashes, starts = [], []
    at = 0
    while at < len(blob):
        to = min(len(blob), at + PIECE)
        while to < len(blob) and flags[to - 1]:
            gap = np.flatnonzero(~flags[to : to + PIECE])
            to = min(len(blob), to + (int(gap[0]) + 1 if len(gap) else PIECE))
        piece, inside = blob[at:to], flags[at:to]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = _powers(len(piece))
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=run[1:])
            hashes.append(mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of runs of ``width`` words of each text.

    A text of 1 to ``width - 1`` words has one shingle of all its words, a text
    without words has none.
    """
    words, off = word_hashes(texts)
    out: list[np.ndarray] = []
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled = (rolled ^ words[k : k + len(rolled)]) * np.uint64(0x9FB21C651E98DF25)
            rolled ^= rolled >> np.uint64(29)
    for a, b in zip(off[:-1], off[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = mix_int(b - a)
            for w in words[a:b]:
                h = mix_int(h * 31 + int(w))
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
