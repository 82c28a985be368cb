"""AES for archives: block encryption and decryption over many blocks at once in numpy, WinZip's counter mode and 7z's CBC."""

from __future__ import annotations

import hashlib
import hmac
from functools import cache

import numpy as np


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@cache
def tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The substitution box, its inverse and multiplication tables, from the field's rule."""
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    box = np.zeros(256, dtype=np.uint8)
    for i, x in enumerate(inverse):
        y = x
        for k in range(1, 5):
            y ^= ((x << k) | (x >> (8 - k))) & 0xFF
        box[i] = y ^ 0x63
    back = np.zeros(256, dtype=np.uint8)
    back[box] = np.arange(256)
    return box, back, {m: np.array([_times(i, m) for i in range(256)], dtype=np.uint8) for m in (2, 3, 9, 11, 13, 14)}


def round_keys(key: bytes) -> np.ndarray:
    box = tables()[0]
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    constant = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= constant
            constant = _times(constant, 2)
        elif n > 6 and i % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(w, words[i - n])])
    return np.array(words, dtype=np.uint8).reshape(-1, 16)


_SHIFT = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
_UNSHIFT = np.argsort(_SHIFT)


def _mixed(state: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
    mul = tables()[2]
    columns = state.reshape(-1, 4, 4)
    out = np.zeros_like(columns)
    for r in range(4):
        for k, f in enumerate(factors):
            part = columns[:, :, (r + k) % 4]
            out[:, :, r] ^= part if f == 1 else mul[f][part]
    return out.reshape(-1, 16)


def encrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """blocks: n x 16 bytes."""
    box = tables()[0]
    state = blocks ^ keys[0]
    for k in keys[1:-1]:
        state = _mixed(box[state][:, _SHIFT], (2, 3, 1, 1)) ^ k
    return box[state][:, _SHIFT] ^ keys[-1]


def decrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    back = tables()[1]
    state = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        state = _mixed(back[state[:, _UNSHIFT]] ^ k, (14, 11, 13, 9))
    return back[state[:, _UNSHIFT]] ^ keys[0]


def cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    blocks = np.frombuffer(data[: len(data) // 16 * 16], dtype=np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, dtype=np.uint8)[None, :], blocks[:-1]])
    return (decrypt(blocks, round_keys(key)) ^ before[: len(blocks)]).tobytes()


def winzip_decrypt(raw: bytes, password: str, strength: int) -> bytes | None:
    """The content of a WinZip AES entry (salt, check, data, code); None where the password is wrong."""
    size = {1: 16, 2: 24, 3: 32}.get(strength)
    if not size or len(raw) < size // 2 + 12:
        return None
    salt, check, data, code = raw[: size // 2], raw[size // 2 : size // 2 + 2], raw[size // 2 + 2 : -10], raw[-10:]
    keys = hashlib.pbkdf2_hmac("sha1", password.encode(), salt, 1000, 2 * size + 2)
    if keys[-2:] != check or not hmac.compare_digest(hmac.new(keys[size : 2 * size], data, "sha1").digest()[:10], code):
        return None
    n = -(-len(data) // 16)
    counters = np.zeros((n, 16), dtype=np.uint8)
    counters[:, :8] = np.arange(1, n + 1, dtype="<u8").view(np.uint8).reshape(-1, 8)
    stream = encrypt(counters, round_keys(keys[:size])).reshape(-1)[: len(data)]
    return (np.frombuffer(data, dtype=np.uint8) ^ stream).tobytes()
