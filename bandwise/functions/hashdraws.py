"""``distributions.normal_draw`` for many draws of a row at once: the same MD5 digests and formula on NumPy arrays.

A column expression hashes, formats and parses text for each draw. Here the messages of a few rows are laid out as
MD5's blocks of 64 bytes (they are short, so each is one block) and hashed together, step by step over 32-bit words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

MESSAGES = 8192  # messages that are hashed together

# FIXED VALUES: shifts of MD5's rounds; its constants are the sines of whole numbers (RFC 1321)
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_words(words: np.ndarray, used: Sequence[int]) -> tuple[np.ndarray, ...]:
    """The four words of the MD5 digest of blocks of one message each: ``words[w]`` holds word w of all, zero outside ``used``."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
            w = i
        elif turn == 1:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
            w = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
            w = (3 * i + 5) % 16
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
            w = 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        if w in used:
            f += words[w]
        by = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(by), g)
        np.right_shift(f, np.uint32(32 - by), f)
        np.bitwise_or(f, g, f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return tuple(v + np.uint32(s) for v, s in zip((a, b, c, d), _START))


@lru_cache(maxsize=16)
def _tails(draws: int) -> tuple[np.ndarray, np.ndarray]:
    """The end ``|<draw>`` of each draw's message with MD5's closing bit, and the ends' lengths."""
    ends = [f"|{i}".encode() for i in range(draws)]
    width = max(map(len, ends)) + 1
    out = np.frombuffer(b"".join((e + b"\x80").ljust(width, b"\0") for e in ends), np.uint8).reshape(draws, width)
    return out, np.array([len(e) for e in ends])


def _uniforms(starts: Sequence[bytes], draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Both uniforms (48 bits of the digest each) of every row's draws; ``starts`` have the same length."""
    tails, lengths = _tails(draws)
    size, width = len(starts[0]), tails.shape[1]
    if size + width > 56:  # the message does not fit one block
        digests = b"".join(hashlib.md5(s + b"|%d" % i).digest() for s in starts for i in range(draws))
        first, second, third, _ = np.frombuffer(digests, ">u4").reshape(-1, 4).T
    else:
        block = np.zeros((len(starts), draws, 64), np.uint8)
        block[:, :, :size] = np.frombuffer(b"".join(starts), np.uint8).reshape(len(starts), 1, size)
        block[:, :, size: size + width] = tails
        block[:, :, 56:58] = ((lengths + size) * 8).astype("<u2")[:, None].view(np.uint8)
        words = np.ascontiguousarray(block.view("<u4").reshape(-1, 16).T)
        first, second, third, _ = (v.byteswap() for v in md5_words(words, {*range(-(-(size + width) // 4)), 14}))
    u1 = first * 65536.0 + (second >> np.uint32(16))
    u2 = (second & np.uint32(0xFFFF)) * 2.0 ** 32 + third
    return (u1 + 0.5) / 2.0 ** 48, (u2 + 0.5) / 2.0 ** 48


def normal_draws(starts: Sequence[bytes], draws: int) -> np.ndarray:
    """Standard-normal draws 0, 1, ... of each row as ``normal_draw`` makes them; ``starts`` are the rows' ``seed|key``."""
    out = np.empty((len(starts), draws))
    size = np.array([len(s) for s in starts])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, MESSAGES // draws)
        for at in (rows[i: i + step] for i in range(0, len(rows), step)):
            u1, u2 = _uniforms([starts[i] for i in at], draws)
            out[at] = (np.sqrt(-2.0 * np.log(u1)) * np.cos(2 * math.pi * u2)).reshape(len(at), draws)
    return out
