"""Keyed draws of many items inside a task, in the order that `exprs.draw_key` gives."""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK = 16_384  # items whose hashes are computed at once
# MD5 (RFC 1321): rotations, constants and start, for messages of one block.
TURNS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
SINES = [int(v) for v in np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
ONE_BLOCK = 55  # bytes of a message


class KeyedOrder:
    """Orders items by the md5 of a head and the item's own tail, ties by the order of the tails given."""

    def __init__(self, tails: list[bytes]):
        self.tails = tails
        self.lengths = np.array([len(t) for t in tails], np.int64)
        self.blocks: dict[int, list] = {}

    def __call__(self, head: str) -> np.ndarray:
        start = head.encode()
        if not self.tails or len(start) + self.lengths.max() > ONE_BLOCK:
            return self._plain(start)
        first = self._first(start)
        order = np.argsort(first)
        met = first[order]
        return self._plain(start) if (met[1:] == met[:-1]).any() else order

    def _plain(self, start: bytes) -> np.ndarray:
        digests = b"".join(hashlib.md5(start + t, usedforsecurity=False).digest() for t in self.tails)
        first, second = np.frombuffer(digests, ">u8").reshape(-1, 2).T
        return np.lexsort((second, first))

    def _block(self, size: int) -> list:
        """The 16 words of each message without its head of `size` bytes; None where they are zero."""
        if size not in self.blocks:
            n = len(self.tails)
            message = np.zeros((n, 64), np.uint8)
            at = np.repeat(np.arange(n), self.lengths)
            place = np.arange(len(at)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
            message[at, size + place] = np.frombuffer(b"".join(self.tails), np.uint8)
            message[np.arange(n), size + self.lengths] = 0x80
            words = message.view("<u4")
            words[:, 14] = 8 * (size + self.lengths)
            self.blocks[size] = [np.ascontiguousarray(w) if w.any() else None for w in words.T]
        return self.blocks[size]

    def _first(self, start: bytes) -> np.ndarray:
        """The first half of each digest as a number."""
        block, head = self._block(len(start)), np.frombuffer(start.ljust(64, b"\0"), "<u4").tolist()
        added = [np.uint32((sine + head[k]) & 0xFFFFFFFF) for sine, k in zip(SINES, WORDS)]
        out = np.empty(len(self.tails), np.uint64)
        for low in range(0, len(out), CHUNK):
            here = [None if w is None else w[low:low + CHUNK] for w in block]
            size = len(out[low:low + CHUNK])
            a, b, c, d = (np.full(size, v, np.uint32) for v in START)
            f = np.empty(size, np.uint32)
            for step, (turn, add, k) in enumerate(zip(TURNS, added, WORDS)):
                if step < 16:
                    np.bitwise_xor(c, d, out=f)
                    f &= b
                    f ^= d
                elif step < 32:
                    np.bitwise_xor(b, c, out=f)
                    f &= d
                    f ^= c
                elif step < 48:
                    np.bitwise_xor(b, c, out=f)
                    f ^= d
                else:
                    np.invert(d, out=f)
                    f |= b
                    f ^= c
                a += f
                a += add
                if here[k] is not None:
                    a += here[k]
                np.left_shift(a, np.uint32(turn), out=f)
                a >>= np.uint32(32 - turn)
                f |= a
                f += b
                a, b, c, d, f = d, f, b, c, a
            a += np.uint32(START[0])
            b += np.uint32(START[1])
            out[low:low + CHUNK] = (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()
        return out
