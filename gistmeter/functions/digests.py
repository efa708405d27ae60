"""MD5 (RFC 1321) of many short strings at a time."""

import hashlib
import math

import numpy as np
import pyarrow as pa

ONE_BLOCK = 55  # bytes of a string that fills no second block
# Rotations, constants and start of the algorithm.
TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
SINES = [np.uint32(int(abs(math.sin(i)) * (1 << 32))) for i in range(1, 65)]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits of the digests of one-block messages, from the 16 words of each block as rows."""
    a, b, c, d = (np.full(blocks.shape[1], x) for x in START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += SINES[i]
        f += blocks[g]
        a, d, c = d, c, b
        b = b + (f << TURNS[i] | f >> (32 - TURNS[i]))
    return a + START[0]


def md5_heads(strings: pa.Array) -> np.ndarray:
    """The first four bytes of each string's digest as a number; of a null that of an empty string."""
    strings = strings.fill_null("").cast(pa.binary())
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, "int32")[strings.offset:strings.offset + len(strings) + 1].astype("int64")
    size, data = np.diff(ends), np.frombuffer(data, "uint8") if data is not None else np.empty(0, "uint8")
    out = np.empty(len(strings), "int64")
    short = np.flatnonzero(size <= ONE_BLOCK)
    blocks = np.zeros((len(short), 64), "uint8")
    n = size[short]
    row = np.repeat(np.arange(len(short)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    blocks[row, place] = data[ends[short][row] + place]
    blocks[np.arange(len(short)), n] = 128
    words = blocks.view("<u4")
    words[:, 14] = n * 8
    out[short] = _first_words(np.ascontiguousarray(words.T)).byteswap()
    for i in np.flatnonzero(size > ONE_BLOCK):
        out[i] = int.from_bytes(hashlib.md5(strings[int(i)].as_py()).digest()[:4])
    return out
