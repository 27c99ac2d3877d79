"""MD5 of many short texts at once, as NumPy arrays."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

#: Texts hashed at once, and the most bytes of a text that is hashed so.
ROWS, SHORT = 8192, 55
_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: (7 * i) % 16]
_BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _block(m: np.ndarray) -> np.ndarray:
    """m: 16 rows of words, a column for each text -> the first 8 bytes of each digest."""
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in _BEGIN)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif part == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif part == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, _K[i], out=f), np.add(f, m[_WORD[part](i)], out=f)
        turn = _TURN[part][i % 4]
        np.left_shift(f, np.uint32(turn), out=g), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # a is not needed any more
        a, b, c, d = d, a, b, c
    return np.ascontiguousarray(np.stack([a + _BEGIN[0], b + _BEGIN[1]], axis=1).astype("<u4")).view(np.uint8)


def first_bytes(prefixes: list[bytes], texts: list[bytes], suffix: bytes) -> np.ndarray:
    """The first 8 bytes of md5(prefix + text + suffix), by text and prefix."""
    out = np.empty((len(texts), len(prefixes), 8), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    fits = size + max(map(len, prefixes)) + len(suffix) <= SHORT
    for i in np.flatnonzero(~fits).tolist():
        out[i] = [list(md5(p + texts[i] + suffix, usedforsecurity=False).digest()[:8]) for p in prefixes]
    short = np.flatnonzero(fits)
    step = max(1, ROWS // len(prefixes))
    for at in range(0, len(short), step):
        own = short[at : at + step]
        n, width = size[own], int(size[own].max(initial=0))
        letters = np.array([texts[i] for i in own.tolist()], f"S{max(1, width)}").view(np.uint8).reshape(len(own), -1)[:, :width]
        blocks, row = np.zeros((len(prefixes), len(own), 64), np.uint8), np.arange(len(own))
        for k, p in enumerate(prefixes):
            b = blocks[k]
            b[:, : len(p)] = np.frombuffer(p, np.uint8)
            b[:, len(p) : len(p) + width] = letters
            for j, x in enumerate([*suffix, 0x80]):
                b[row, len(p) + n + j] = x
            b[:, 56:58] = ((len(p) + n + len(suffix)) * 8).astype("<u2")[:, None].view(np.uint8)
        words = np.ascontiguousarray(blocks.reshape(-1, 64).view("<u4").T)
        out[own] = _block(words).reshape(len(prefixes), len(own), 8).transpose(1, 0, 2)
    return out
