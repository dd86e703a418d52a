"""AES-128 in ECB mode (FIPS 197), decryption only, for all blocks of a stream at once."""

from __future__ import annotations

import numpy as np


def _times(a: int, b: int) -> int:
    """The product in GF(2^8) modulo x^8 + x^4 + x^3 + x + 1."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> np.ndarray:
    """Inverses in the field (powers of the generator 3), then the affine map."""
    power = [1]
    while len(power) < 255:
        power.append(_times(power[-1], 3))
    inverse = {p: power[-k % 255] for k, p in enumerate(power)} | {0: 0}
    turn = lambda x, n: (x << n | x >> (8 - n)) & 0xFF
    return np.array([(v := inverse[x]) ^ turn(v, 1) ^ turn(v, 2) ^ turn(v, 3) ^ turn(v, 4) ^ 0x63 for x in range(256)], np.uint8)


_S = _substitution()
_INVERSE_S = np.argsort(_S).astype(np.uint8)
_TIMES = {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}
#: Byte i of a block stands in row i % 4 and column i // 4; row r moves r columns to the right.
_UNSHIFT = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])


def _round_keys(key: bytes) -> np.ndarray:
    words = [np.frombuffer(key[4 * i : 4 * i + 4], np.uint8) for i in range(4)]
    constant = 1
    while len(words) < 44:
        w = words[-1]
        if len(words) % 4 == 0:
            w = _S[np.roll(w, -1)] ^ np.array([constant, 0, 0, 0], np.uint8)
            constant = _times(constant, 2)
        words.append(words[-4] ^ w)
    return np.concatenate(words).reshape(11, 16)


def decrypt(data: bytes, key: bytes) -> bytes:
    """The whole blocks of ``data`` decrypted."""
    keys = _round_keys(key)
    x = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16) ^ keys[10]
    for k in range(9, -1, -1):
        x = _INVERSE_S[x[:, _UNSHIFT]] ^ keys[k]
        if k:
            a = x.reshape(-1, 4, 4)
            mixed = [_TIMES[14][a[..., i]] ^ _TIMES[11][a[..., (i + 1) % 4]] ^ _TIMES[13][a[..., (i + 2) % 4]] ^ _TIMES[9][a[..., (i + 3) % 4]] for i in range(4)]
            x = np.stack(mixed, axis=-1).reshape(-1, 16)
    return x.tobytes()
