"""Simple-8b word-aligned coding of token ids.

A block is up to ``BLOCK`` ids in little-endian 64-bit words. The top 4 bits of a
word are its selector, the low 60 bits hold the ids, first id lowest:

    selector  0    1    2   3   4   5   6   7   8  9  10  11  12  13
    ids       240  120  60  30  20  15  12  10  8  7  6   5   4   3
    bits      0    0    1   2   3   4   5   6   7  8  10  12  15  20

Selector 14 holds one id of up to 60 bits; selector 15 is the escape: the next word
is one raw 64-bit id. Two ids of 30 bits share no selector; token ids do not need it.
A word at a block's end may claim more ids than are left; the rest is zero.

A segment is a run of blocks: magic ``TLS8``, u32 version, u32 ids, u32 blocks, then
u32 word offsets of the blocks (blocks + 1 of them), then the words. Every block but
the last has exactly ``BLOCK`` ids, so block b's ids start at b * BLOCK and all
blocks are decoded side by side.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK, MAGIC, VERSION = 512, b"TLS8", 1
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 1, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 60, 64])
_HEAD = struct.Struct("<4sIII")


def _least_selector() -> np.ndarray:
    """Selector with the fewest bits that holds a value, for values of two bytes."""
    table = np.full(1 << 16, 13, np.uint8)
    for sel in range(13, 1, -1):
        table[: 1 << BITS[sel]] = sel
    table[0] = 0
    return table


_LEAST = _least_selector()


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each position of (blocks, BLOCK) ids: the selector with most ids that fits there."""
    n, width = ids.shape
    if not ids.size or ids.max() < 1 << 16:
        need = _LEAST[ids.astype(np.uint16)]
    else:
        need = _LEAST[np.minimum(ids, np.uint64(0xFFFF)).astype(np.uint16)]
        need[ids >= np.uint64(1 << 20)] = 14
        need[ids >= np.uint64(1 << 60)] = 15
    best = np.where(need <= 14, 14, 15).astype(np.uint8)
    top = {1: np.concatenate([need, np.zeros((n, 256), np.uint8)], axis=1)}
    for sel in range(13, -1, -1):
        count = int(COUNTS[sel])
        half = 1 << (count.bit_length() - 1)
        size = max(top)
        while size < half:
            top[size * 2] = np.maximum(top[size][:, :-size], top[size][:, size:])
            size *= 2
        p = top[half]
        run = np.maximum(p[:, :width], p[:, count - half : count - half + width])
        fits = run <= (sel if sel > 1 else 0)
        if not fits.any():
            break  # more ids of fewer bits cannot fit either
        best[fits] = sel
    return best


def encode(ids: np.ndarray) -> bytes:
    """A segment of the given ids (any unsigned 64-bit values)."""
    ids = np.asarray(ids, np.uint64)
    total = len(ids)
    blocks = -(-total // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid.reshape(-1)[:total] = ids
    left = np.full(blocks, BLOCK)
    if blocks:
        left[-1] = total - (blocks - 1) * BLOCK
    best = _selectors(grid) if blocks else np.zeros((0, BLOCK), np.uint8)
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # block, position, selector
    while len(rows):
        sel = best[rows, at[rows]]
        words.append((rows, at[rows], sel))
        at[rows] += COUNTS[sel]
        rows = rows[at[rows] < left[rows]]
    count = np.array([len(w[0]) for w in words], np.int64)
    block, pos, sel = (np.concatenate(x) for x in zip(*words)) if words else [np.zeros(0, np.int64)] * 3
    slots = np.where(sel == 15, 2, 1)
    if (slots == 1).all():  # a block's words are numbered by the step that made them
        length = np.bincount(block, minlength=blocks)
        place = (np.cumsum(length) - length)[block] + np.repeat(np.arange(len(words)), count)
    else:
        order = np.lexsort((pos, block))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(slots[order]) - slots[order]
    out = np.zeros(int(slots.sum()), np.uint64)
    wide = np.concatenate([grid, np.zeros((blocks, 256), np.uint64)], axis=1)
    for s in np.unique(sel):
        m = np.flatnonzero(sel == s)
        word = np.full(len(m), np.uint64(int(s)) << np.uint64(60))
        if s == 15:
            out[place[m] + 1] = wide[block[m], pos[m]]
        elif s > 1:
            first = block[m] * wide.shape[1] + pos[m]
            for k in range(COUNTS[s]):
                word |= wide.reshape(-1)[first + k] << np.uint64(k * BITS[s])
        out[place[m]] = word
    offsets = np.concatenate([[0], np.cumsum(np.bincount(block, slots, blocks))]).astype("<u4") if blocks else np.zeros(1, "<u4")
    return _HEAD.pack(MAGIC, VERSION, total, blocks) + offsets.tobytes() + out.astype("<u8").tobytes()


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment."""
    magic, version, total, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a Simple-8b segment of this version")
    offsets = np.frombuffer(data, "<u4", blocks + 1, _HEAD.size).astype(np.int64)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), _HEAD.size + 4 * (blocks + 1))
    if not total:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(sel == 15)
    last = -1
    for e in escapes:  # a raw word may look like anything; escapes are rare
        if not (last == e - 1 and raw[e]):
            if e + 1 < len(words):
                raw[e + 1] = True
        last = e
    # a word after an escape is data even if its top bits say otherwise
    count = np.where(raw, 0, COUNTS[sel])
    first = np.cumsum(count) - count
    owner = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    wide = BLOCK + 256  # a block's last word may claim ids past its end
    begin = first - first[offsets[:-1]][owner] + owner * wide
    out = np.zeros(blocks * wide, np.uint64)
    for s in np.unique(sel[~raw]):
        if s < 2:
            continue
        m = np.flatnonzero((sel == s) & ~raw)
        at, word = begin[m], words[m]
        if s == 15:
            out[at] = words[m + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            out[at + k] = (word >> np.uint64(k * BITS[s])) & mask
    out = out.reshape(blocks, wide)[:, :BLOCK].reshape(-1)
    return out[:total]
