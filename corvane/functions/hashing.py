"""SHA-1 of very many short texts at once, column by column: the keys of `numeric.hash_key` inside a task."""

from __future__ import annotations

import hashlib

import numpy as np

#: Texts that are hashed side by side, so that their words stay in a core's cache.
SIDE = 16_384
# The algorithm's constants and start.
_ROUND = [0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0]


def tails(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, bytes as a matrix) of the texts of each length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = []
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out.append((at, np.frombuffer(b"".join([texts[i] for i in at.tolist()]), np.uint8).reshape(len(at), n)))
    return out


def sha1_heads(prefix: bytes, rest: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The first 64 bits of the SHA-1 of `prefix` with each of the `n` texts of `tails`."""
    out = np.empty(n, np.uint64)
    for at, matrix in rest:
        for k in range(0, len(at), SIDE):
            out[at[k : k + SIDE]] = _heads(prefix, matrix[k : k + SIDE])
    return out


def _heads(prefix: bytes, matrix: np.ndarray) -> np.ndarray:
    n, size = len(matrix), len(prefix) + matrix.shape[1]
    if size > 55:  # more than one block
        both = b"".join([hashlib.sha1(prefix + m.tobytes()).digest()[:8] for m in matrix])
        return np.frombuffer(both, ">u8").astype(np.uint64)
    block = np.zeros((n, 64), np.uint8)
    block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    block[:, len(prefix) : size] = matrix
    block[:, size] = 0x80
    block[:, 56:] = np.frombuffer((8 * size).to_bytes(8, "big"), np.uint8)
    w = list(np.ascontiguousarray(block.view(">u4").astype(np.uint32).T))
    a, b, c, d, e = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    left = lambda x, k: np.left_shift(x, np.uint32(k), out=t)
    for i in range(80):
        s = i & 15
        if i >= 16:
            x = w[s]
            x ^= w[(i - 3) & 15]
            x ^= w[(i - 8) & 15]
            x ^= w[(i - 14) & 15]
            left(x, 1)
            x >>= np.uint32(31)
            x |= t
        if i < 20:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif 40 <= i < 60:
            np.bitwise_or(c, d, out=f)
            f &= b
            np.bitwise_and(c, d, out=t)
            f |= t
        else:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        e += f
        e += w[s]
        e += np.uint32(_ROUND[i // 20])
        left(a, 5)
        np.right_shift(a, np.uint32(27), out=f)
        f |= t
        e += f
        left(b, 30)
        b >>= np.uint32(2)
        b |= t
        a, b, c, d, e = e, a, b, c, d
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.astype(np.uint64) << np.uint64(32)) | b
