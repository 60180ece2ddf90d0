"""Exact token ids with the tokenizers library, each distinct chunk encoded once per worker.

Both public vocabularies split a text before they merge, and no token crosses the chunk borders
used here, so ids of a text are the ids of its chunks in order; a text that holds an added token's literal is encoded
whole. Chunks repeat, so each goes through the
library once and is then looked up; the cache is bounded by its number of entries.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import pyarrow as pa

#: White space as the library's own regular expressions see it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: U+0130 is left out: lower-casing makes a letter and a mark of it.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
STOP = r"(?=[ \n.,!?]|\Z)"
#: Words of plain letters before a plain separator, else whole runs without white space. A leading space belongs to the byte-level word.
CHUNKS = {
    "byte_bpe": re.compile(rf" ?[{LETTERS}]+{STOP}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "word_bpe": re.compile(rf"[{LETTERS}]+{STOP}|[^{SPACE}]+"),
}
CACHE = 1_000_000
LONGEST = 64
#: Flat bytes that are split at once.
STEP = 4 << 20


def _splits(b: np.ndarray, starts: np.ndarray, spaced: bool) -> np.ndarray:
    """Places where chunks start in flat UTF-8 bytes of texts without odd white space; `starts` of non-empty texts.

    The same borders as CHUNKS has, but each run of white space between words is a chunk of its own too.
    """
    space = _SPACE[b]
    first = np.zeros(len(b) + 1, bool)
    first[starts] = True
    first[-1] = True
    before = np.empty(len(b), bool)  # white space before, in the same text
    before[0] = False
    before[1:] = space[:-1]
    before[first[:-1]] = False
    cut = first[:-1].copy()
    word = ~space & before  # a word starts after white space
    cut |= space & ~before
    if spaced:
        at = np.flatnonzero(word)
        cut[at - 1] = True  # the last white space of a run: a space belongs to the word, another stands alone
        cut[at[b[at - 1] != 32]] = True
    else:
        cut |= word
    at = np.flatnonzero(_STOP[b] & ~first[:-1])
    p, q = b[at - 1], b[np.maximum(at - 2, 0)]
    latin = (p >= 0x80) & (p < 0xC0) & (q >= 0xC3) & (q <= 0xC9) & ~((q == 0xC3) & ((p == 0x97) | (p == 0xB7))) & ~((q == 0xC4) & (p == 0xB0))
    cut[at[_ASCII[p] | latin]] = True
    return np.flatnonzero(cut)


def _table(of: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(of, np.uint8)] = True
    return t


_SPACE, _STOP = _table(b" \t\n\x0b\x0c\r"), _table(b".,!?")
_ASCII = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
#: Texts with these take the regular expression's path: other white space starts with one of these bytes.
_ODD = re.compile("[\x85\xa0\u1000-\u3fff]")


class Ids:
    """texts -> for each its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are found in the raw text before it is split, so texts with one go through the library whole.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = CHUNKS[kind].findall
        self.spaced = kind == "byte_bpe"
        self.cache: dict[bytes, bytes] = {}

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk; new ones go through the library."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = list(map(self.cache.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in some], add_special_tokens=False), strict=True):
                ids = e.ids
                found[i] = b = struct.pack(f"<{len(ids)}I", *ids)
                if len(chunks[i]) <= LONGEST:
                    self.cache[chunks[i]] = b
        return found

    def _flat(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = b"".join(texts)
        b, ends = np.frombuffer(flat, np.uint8), np.cumsum(sizes)
        if not len(b):
            return [b""] * len(texts)
        starts = ends - sizes
        cuts = _splits(b, starts[sizes > 0], self.spaced)
        offsets = np.append(cuts, len(b)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        found = self._known(coded.dictionary.to_pylist())
        lengths = np.array([len(x) for x in found], np.int64) >> 2
        ids, at, which = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        n = lengths[which]
        to = np.cumsum(n)
        out = ids[np.repeat(at[which] - (to - n), n) + np.arange(to[-1])].tobytes()
        upto = np.append(0, to)[np.searchsorted(cuts, np.append(starts, len(b)))] * 4
        return [out[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if any(x in t for x in self.added):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            if _ODD.search(t):
                out[i] = b"".join(self._known([c.encode() for c in self.chunks(t)]))
                continue
            held.append((i, t.encode()))
            size += len(held[-1][1])
            if size >= STEP or len(held) == len(texts):
                self._fill(out, held)
                held, size = [], 0
        self._fill(out, held)
        return out

    def _fill(self, out: list[bytes], held: list[tuple[int, bytes]]) -> None:
        for (i, _), ids in zip(held, self._flat([t for _, t in held]), strict=True):
            out[i] = ids


@functools.lru_cache(maxsize=4)
def ids_of(path: str, kind: str) -> Ids:
    """One instance per worker process."""
    return Ids(path, kind)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
