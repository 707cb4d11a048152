"""SHA-256 over many rows at once, with states that can be kept and resumed.

A digest as hexadecimal text has 64 bytes, one block of SHA-256. So the state before the
k-th digest of a parent is the state after k whole blocks: 8 words, and nothing pending.
"""

from __future__ import annotations

import numpy as np


def _fractions(power: int, n: int) -> list[int]:
    """First 32 bits of the fractional parts of the roots of the first n primes, as the standard defines its constants."""
    primes, out = [], []
    candidate = 2
    while len(primes) < n:
        if all(candidate % p for p in primes):
            primes.append(candidate)
        candidate += 1
    for p in primes:
        low, high = 0, 1 << 40
        while low < high - 1:  # the largest x with x**power <= p * 2**(32 * power)
            middle = (low + high) // 2
            low, high = (middle, high) if middle**power <= p << 32 * power else (low, middle)
        out.append(low & 0xFFFFFFFF)
    return out


START = np.array(_fractions(2, 8), np.uint32)
ROUNDS = [np.uint32(k) for k in _fractions(3, 64)]
_HEX = np.array([[ord(c) for c in f"{b:02x}"] for b in range(256)], np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) each."""
    w = list(np.ascontiguousarray(blocks.T))
    start = np.ascontiguousarray(states.T)
    a, b, c, d, e, f, g, h = start
    for t in range(64):
        if t > 15:
            x, y = w[(t + 1) % 16], w[(t + 14) % 16]
            mixed = (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
            w[t % 16] = w[t % 16] + w[(t + 9) % 16] + mixed
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[t] + w[t % 16]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return (np.stack([a, b, c, d, e, f, g, h]) + start).T


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8 words) as the blocks (n, 16 words) of their hexadecimal text."""
    octets = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8)
    return _HEX[octets].reshape(len(digests), 64).view(">u4").astype(np.uint32)


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of `blocks` (n) whole blocks each."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[:, 14], last[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(states, last)


def words(raw: list[bytes]) -> np.ndarray:
    """Digests or states of 32 bytes each as words (n, 8)."""
    return np.frombuffer(b"".join(raw), ">u4").astype(np.uint32).reshape(-1, 8)


def octets(rows: np.ndarray) -> list[bytes]:
    raw = rows.astype(">u4").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]
