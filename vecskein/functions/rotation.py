"""The random rotation that codes are made in, and its inverse.

Four rounds of sign flips, a Hadamard transform on a power-of-two window, and, where the dimension isn't a power
of two, a half turn that mixes both halves. The signs come from a ChaCha stream of twelve rounds under a fixed key, so the
rotation is the same everywhere. All functions take and give matrices, one vector a row.
"""

from __future__ import annotations

from functools import cache

import numpy as np

ROUNDS, PLANE_BYTES = 4, 8192


def _chacha12(key: bytes, words: int) -> np.ndarray:
    """The first output words of the stream with counter and nonce zero, all blocks at once."""
    blocks = -(-words // 16)
    state = np.zeros((16, blocks), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(blocks)
    x = state.copy()

    def turn(v: np.ndarray, n: int) -> np.ndarray:
        return (v << np.uint32(n)) | (v >> np.uint32(32 - n))

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for left, by, out, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[left] += x[by]
            x[out] = turn(x[out] ^ x[left], n)

    for _ in range(6):
        for k in range(4):
            quarter(k, 4 + k, 8 + k, 12 + k)
        for k in range(4):
            quarter(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4)
    return (x + state).T.reshape(-1)[:words]


@cache
def signs() -> np.ndarray:
    """+1 or -1 of every round and component."""
    raw = (_chacha12(bytes([7] * 32), ROUNDS * PLANE_BYTES) & np.uint32(0xFF)).astype(np.uint8)
    bits = np.unpackbits(raw.reshape(ROUNDS, PLANE_BYTES), axis=1, bitorder="little")
    return 1.0 - 2.0 * bits


def _hadamard(x: np.ndarray) -> None:
    """In place along the last axis, scaled to be orthogonal."""
    n, width = x.shape[1], 1
    while width < n:
        pair = x.reshape(len(x), -1, 2, width)
        low, high = pair[:, :, 0].copy(), pair[:, :, 1].copy()
        pair[:, :, 0], pair[:, :, 1] = low + high, low - high
        width *= 2
    x /= np.sqrt(n)


def _half_turn(x: np.ndarray) -> None:
    h = x.shape[1] // 2
    left, right = x[:, :h].copy(), x[:, x.shape[1] - h :].copy()
    x[:, :h], x[:, x.shape[1] - h :] = (left + right) / np.sqrt(2), (left - right) / np.sqrt(2)  # it is its own inverse


def _window(n: int, k: int) -> slice:
    p = 1 << (n.bit_length() - 1)
    return slice(0, p) if k % 2 == 0 else slice(n - p, n)


def rotate(x: np.ndarray) -> np.ndarray:
    x = np.array(x, np.float64, ndmin=2)
    n = x.shape[1]
    for k in range(ROUNDS):
        x *= signs()[k, :n]
        part = np.ascontiguousarray(x[:, _window(n, k)])
        _hadamard(part)
        x[:, _window(n, k)] = part
        if n & (n - 1):
            _half_turn(x)
    return x


def unrotate(x: np.ndarray) -> np.ndarray:
    x = np.array(x, np.float64, ndmin=2)
    n = x.shape[1]
    for k in reversed(range(ROUNDS)):
        if n & (n - 1):
            _half_turn(x)
        part = np.ascontiguousarray(x[:, _window(n, k)])
        _hadamard(part)
        x[:, _window(n, k)] = part
        x *= signs()[k, :n]
    return x
