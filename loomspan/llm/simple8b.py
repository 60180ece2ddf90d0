"""Token ids in files of Simple-8b words: a selector and 60 payload bits in each 64-bit word.

File: frames one after another. Frame: MAGIC, six uint64 (documents, ids, words, escapes, blocks, flags of
null document ids), then document ids (int64), nulls (uint8), ids per document (int64), word offset of
each block (uint32), words (uint64), escape positions (uint32) and values (uint32).

The selector in the top 4 bits says how many ids a word packs and how wide each is. Ids of over WIDEST
bits are escapes: the word holds 0 and the value stands in the escape list. Words never cross a block of
BLOCK ids, and each block has its offset, so blocks are encoded and decoded side by side.
"""

from __future__ import annotations

import io
import struct

import numpy as np

MAGIC = b"LSS8B\x00\x01\x00"
BLOCK = 256
#: (ids, bits of each) by selector.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20))
WIDEST = 20
COUNTS = np.array([n for n, _ in SELECTORS])
#: Bits of each value that is no escape.
BITS = np.repeat(np.arange(WIDEST + 1, dtype=np.uint8), [1, *(1 << b for b in range(WIDEST))])


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, escape positions, escape values) of uint32 ids."""
    at = np.flatnonzero(ids >> WIDEST)
    values = ids[at].astype(np.uint32)
    if len(at):
        ids = ids.copy()
        ids[at] = 0
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK + 240), np.uint32)
    flat = np.zeros(blocks * BLOCK, np.uint32)
    flat[: len(ids)] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = BITS[grid]
    widest, best = {1: bits}, np.full((blocks, BLOCK), len(SELECTORS) - 1, np.uint8)

    def window(n: int) -> np.ndarray:
        """The widest id of the n that start at each place."""
        if n not in widest:
            half = n // 2
            a, b = window(n - half), window(half)
            w = a.copy()
            w[:, : w.shape[1] - (n - half)] = np.maximum(a[:, : w.shape[1] - (n - half)], b[:, n - half :])
            widest[n] = w
        return widest[n]

    for s in range(len(SELECTORS) - 2, -1, -1):
        n, w = SELECTORS[s]
        best[window(n)[:, :BLOCK] <= w] = s
    left = np.minimum(len(ids) - np.arange(blocks) * BLOCK, BLOCK)
    pos, alive, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(alive):
        sel = best[alive, pos[alive]]
        steps.append((alive, pos[alive].copy(), sel))
        pos[alive] += COUNTS[sel]
        alive = alive[pos[alive] < left[alive]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), at.astype(np.uint32), values
    block, start, sel = (np.concatenate([x[i] for x in steps]) for i in range(3))
    order = np.lexsort((start, block))
    block, start, sel = block[order], start[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s, (n, w) in enumerate(SELECTORS):
        if w and len(k := np.flatnonzero(sel == s)):
            for j in range(n):
                words[k] |= grid[block[k], start[k] + j].astype(np.uint64) << np.uint64(j * w)
    offsets = np.searchsorted(block, np.arange(blocks)).astype(np.uint32)
    return words, offsets, at.astype(np.uint32), values


def decode(words: np.ndarray, offsets: np.ndarray, at: np.ndarray, values: np.ndarray, n_ids: int) -> np.ndarray:
    """The uint32 ids, all words of a selector at once."""
    out = np.zeros(len(offsets) * BLOCK + 240, np.uint32)
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[sel])
    starts = ends - COUNTS[sel]
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words)).astype(np.int64)))
    starts += block * BLOCK - starts[offsets.astype(np.int64)][block] if len(words) else 0
    for s, (n, w) in enumerate(SELECTORS):
        if w and len(k := np.flatnonzero(sel == s)):
            mask, limit = np.uint64((1 << w) - 1), (block[k] + 1) * BLOCK
            for j in range(n):
                here = starts[k] + j
                inside = here < limit
                out[here[inside]] = ((words[k[inside]] >> np.uint64(j * w)) & mask).astype(np.uint32)
    out[at.astype(np.int64)] = values
    return out[:n_ids]


def frame(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, at, values = encode(ids)
    head = MAGIC + struct.pack("<6Q", len(doc_ids), len(ids), len(words), len(at), len(offsets), int(nulls.any()))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), counts.astype("<i8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), at.astype("<u4").tobytes(), values.astype("<u4").tobytes()])


def frames(file: io.RawIOBase):
    """(document ids, nulls, ids per document, ids) of each frame of an open file."""

    def read(dtype: str, n: int) -> np.ndarray:
        data = file.read(n * np.dtype(dtype).itemsize)
        if len(data) != n * np.dtype(dtype).itemsize:
            raise EOFError("truncated frame")
        return np.frombuffer(data, dtype)

    while head := file.read(len(MAGIC) + 48):
        if head[: len(MAGIC)] != MAGIC or len(head) != len(MAGIC) + 48:
            raise ValueError("no Simple-8b frame here")
        docs, n_ids, words, escapes, blocks, _ = struct.unpack("<6Q", head[len(MAGIC) :])
        doc_ids, nulls, counts = read("<i8", docs), read("u1", docs), read("<i8", docs)
        offsets, packed, at, values = read("<u4", blocks), read("<u8", words), read("<u4", escapes), read("<u4", escapes)
        yield doc_ids, nulls.astype(bool), counts, decode(packed, offsets, at, values, n_ids)
