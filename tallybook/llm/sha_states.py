"""SHA-256 as states that can be kept and resumed, for many messages at a time.

``hashlib`` copies a state only within a process. Here a state is eight 32-bit words, kept in tables like any value.
Messages are runs of digests in hex, each of which is exactly one block of 64 bytes: a state is complete between
any two of them, and nothing is buffered.
"""

from __future__ import annotations

import math

import numpy as np

_W = np.uint32
#: Lanes that are worked on together; their intermediate words stay in the processor's caches.
LANES = 4096


def _root_bits(prime: int, power: int) -> int:
    """The first 32 bits of the fraction of a prime's square (2) or cube (3) root."""
    scaled = prime << (32 * power)
    if power == 2:
        return math.isqrt(scaled) & 0xFFFFFFFF
    root = round(scaled ** (1 / 3))
    while root**3 > scaled:
        root -= 1
    while (root + 1) ** 3 <= scaled:
        root += 1
    return root & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, math.isqrt(n) + 1))][:64]
_ROUNDS = np.array([_root_bits(p, 3) for p in _PRIMES], _W)
#: The state before the first block, the same for every message.
INITIAL = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], _W)
_HEX = np.array([int.from_bytes(f"{v:02x}".encode(), "big") for v in range(256)], _W)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> _W(by)) | (x << _W(32 - by))


def _absorb(state: np.ndarray, block: list[np.ndarray]) -> np.ndarray:
    schedule = list(block)
    for i in range(16, 64):
        a, b = schedule[i - 15], schedule[i - 2]
        low = _turn(a, 7) ^ _turn(a, 18) ^ (a >> _W(3))
        high = _turn(b, 17) ^ _turn(b, 19) ^ (b >> _W(10))
        schedule.append(schedule[i - 16] + low + schedule[i - 7] + high)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        mixed = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + schedule[i] + _ROUNDS[i]
        major = (a & b) | (c & (a | b))
        h, g, f, e, d, c, b, a = g, f, e, d + mixed, c, b, a, mixed + (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + major
    return state + np.stack([a, b, c, d, e, f, g, h])


def _by_lanes(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    out = np.empty((len(state), 8), _W)
    for k in range(0, len(state), LANES):
        own = slice(k, k + LANES)
        words = list(np.ascontiguousarray(block[own].T))
        out[own] = _absorb(np.ascontiguousarray(state[own].T), words).T
    return out


def fresh(n: int) -> np.ndarray:
    return np.tile(INITIAL, (n, 1))


def absorb(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states (n x 8) after one digest (n x 8 words) more each, which enters as 64 hex characters."""
    data = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(-1, 32)
    text = _HEX[data]
    return _by_lanes(states, (text[:, 0::2] << _W(16)) | text[:, 1::2])


def close(states: np.ndarray, absorbed: np.ndarray) -> np.ndarray:
    """The digests (n x 8 words) of messages that end after ``absorbed`` digests."""
    block = np.zeros((len(states), 16), _W)
    block[:, 0] = 0x80000000
    bits = np.asarray(absorbed, np.int64) * 512
    block[:, 14], block[:, 15] = bits >> 32, bits & 0xFFFFFFFF
    return _by_lanes(states, block)


def words_of(raw: bytes) -> np.ndarray:
    """Digests or states, 32 bytes each, as n x 8 words."""
    return np.frombuffer(raw, ">u4").astype(_W).reshape(-1, 8)


def bytes_of(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()
