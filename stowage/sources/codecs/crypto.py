"""AES over many blocks at once, ZipCrypto, and the key derivations of ZIP, 7z and RAR."""

from __future__ import annotations

import hashlib
import hmac
import struct

import numpy as np

from ...model import ArchiveError


def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """S-box, its inverse and products in GF(2**8), from the field's definition."""
    exp, log = [0] * 512, [0] * 256
    x = 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x ^= x << 1
        if x & 256:
            x ^= 0x11B
    box = [0] * 256
    for v in range(256):
        inv = exp[255 - log[v]] if v else 0
        s = 0x63
        for k in range(5):
            s ^= (inv << k | inv >> 8 - k) & 255
        box[v] = s
    inverse = [0] * 256
    for v, s in enumerate(box):
        inverse[s] = v
    times = {m: np.array([exp[log[v] + log[m]] if v else 0 for v in range(256)], np.uint8) for m in (2, 3, 9, 11, 13, 14)}
    return np.array(box, np.uint8), np.array(inverse, np.uint8), times


_BOX, _INVERSE, _TIMES = _tables()
_SHIFT = np.array([4 * ((c + r) % 4) + r for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)


def _round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    rcon = 1
    while len(words) < 4 * (n + 7):
        t = list(words[-1])
        if len(words) % n == 0:
            t = [int(_BOX[b]) for b in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = rcon << 1 ^ (0x11B if rcon & 128 else 0)
        elif n > 6 and len(words) % n == 4:
            t = [int(_BOX[b]) for b in t]
        words.append([a ^ b for a, b in zip(words[-n], t)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mixed(s: np.ndarray, a: int, b: int, c: int, d: int) -> np.ndarray:
    cols = s.reshape(len(s), 4, 4)
    by = lambda m, x: x if m == 1 else _TIMES[m][x]
    rows = [cols[:, :, i] for i in range(4)]
    return np.stack([by(a, rows[i]) ^ by(b, rows[(i + 1) % 4]) ^ by(c, rows[(i + 2) % 4]) ^ by(d, rows[(i + 3) % 4]) for i in range(4)], axis=2).reshape(len(s), 16)


def aes_encrypt(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """Blocks (n x 16), each on its own."""
    keys = _round_keys(key)
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = _mixed(_BOX[s][:, _SHIFT], 2, 3, 1, 1) ^ k
    return _BOX[s][:, _SHIFT] ^ keys[-1]


def aes_decrypt(key: bytes, blocks: np.ndarray) -> np.ndarray:
    keys = _round_keys(key)
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(_INVERSE[s[:, _UNSHIFT]] ^ k, 14, 11, 13, 9)
    return _INVERSE[s[:, _UNSHIFT]] ^ keys[0]


def aes_cbc(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC decryption; the data are whole blocks."""
    if len(data) % 16:
        raise ArchiveError("truncated")
    if not data:
        return b""
    c = np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.vstack([np.frombuffer(iv, np.uint8)[None, :], c[:-1]])
    return (aes_decrypt(key, c) ^ before).tobytes()


def aes_ctr_le(key: bytes, data: bytes) -> bytes:
    """Counter mode as WinZip has it: little-endian, from 1."""
    n = -(-len(data) // 16)
    counter = np.zeros((n, 16), np.uint8)
    counter[:, :8] = (np.arange(n, dtype="<u8") + 1).view(np.uint8).reshape(n, 8)
    stream = aes_encrypt(key, counter).reshape(-1)[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def winzip_aes(data: bytes, password: bytes, strength: int) -> bytes:
    """Salt, check value, cipher text and authentication code of an AES entry -> plain bytes."""
    salt_size, key_size = 4 + 4 * strength, 8 + 8 * strength
    if len(data) < salt_size + 12:
        raise ArchiveError("truncated")
    salt, check, body, tag = data[:salt_size], data[salt_size : salt_size + 2], data[salt_size + 2 : -10], data[-10:]
    derived = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * key_size + 2)
    if not hmac.compare_digest(derived[-2:], check):
        raise ArchiveError("wrongPassword")
    if not hmac.compare_digest(hmac.new(derived[key_size : 2 * key_size], body, "sha1").digest()[:10], tag):
        raise ArchiveError("checksumMismatch", "authentication code")
    return aes_ctr_le(derived[:key_size], body)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


_CRC = _crc_table()


def zipcrypto(data: bytes, password: bytes, check: int) -> bytes:
    """The traditional cipher; the last of its 12 head bytes must equal check."""
    if len(data) < 12:
        raise ArchiveError("truncated")
    a, b, c = 0x12345678, 0x23456789, 0x34567890

    def feed(x: int) -> None:
        nonlocal a, b, c
        a = a >> 8 ^ _CRC[(a ^ x) & 255]
        b = ((b + (a & 255)) * 134775813 + 1) & 0xFFFFFFFF
        c = c >> 8 ^ _CRC[(c ^ b >> 24) & 255]

    for x in password:
        feed(x)
    out = bytearray(len(data))
    for i, x in enumerate(data):
        t = c | 2
        x ^= (t * (t ^ 1)) >> 8 & 255
        out[i] = x
        feed(x)
    if out[11] != check:
        raise ArchiveError("wrongPassword")
    return bytes(out[12:])


def seven_zip_key(password: str, salt: bytes, power: int, most: int) -> bytes:
    if power == 0x3F:
        return (salt + password.encode("utf-16-le"))[:32].ljust(32, b"\0")
    if power > min(most, 62):
        raise ArchiveError("limitExceeded", "7z key derivation")
    unit, h = salt + password.encode("utf-16-le"), hashlib.sha256()
    total, at = 1 << power, 0
    while at < total:  # in runs, so that the digest sees long buffers
        n = min(4096, total - at)
        h.update(b"".join([unit + i.to_bytes(8, "little") for i in range(at, at + n)]))
        at += n
    return h.digest()


def rar_key(password: bytes, salt: bytes) -> tuple[bytes, bytes]:
    """AES-128 key and initial vector of RAR 2.9 to 4: 2**18 rounds of one SHA-1.

    The original overwrites whole blocks of a long password by the last 16 words of their message schedule after hashing them in place; later rounds read those."""
    raw, sha, done, iv = bytearray(password + salt), hashlib.sha1(), 0, []
    for i in range(1 << 18):
        sha.update(raw)
        at = 64 - done % 64
        while at + 64 <= len(raw):
            w = list(struct.unpack_from(">16I", raw, at))
            for t in range(16, 80):
                x = w[t - 3] ^ w[t - 8] ^ w[t - 14] ^ w[t - 16]
                w.append((x << 1 | x >> 31) & 0xFFFFFFFF)
            struct.pack_into("<16I", raw, at, *w[64:])
            at += 64
        sha.update(i.to_bytes(3, "little"))
        done += len(raw) + 3
        if not i & 0x3FFF:
            iv.append(sha.digest()[19])
    words = struct.unpack(">5I", sha.digest())
    return struct.pack("<4I", *words[:4]), bytes(iv)
