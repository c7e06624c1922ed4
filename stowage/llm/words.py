"""Hashes of words, made by numpy over slices of text.

A word is a maximal run of characters other than the six ASCII blanks, with A-Z lower-cased. Long texts are
cut at blanks and long words are hashed in pieces, so temporary arrays stay within a few SLICEs at any length.
"""

from __future__ import annotations

import re

import numpy as np

#: Characters of text hashed at once.
SLICE = 1 << 18

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_BLANKS = " \t\n\v\f\r"
_BLANK = re.compile(f"[{_BLANKS}]")
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * SLICE)
        inverse = pow(_P, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)])) for b in (_P, inverse)]
    return _powers[0], _powers[1]


def _lowered(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)) * np.uint8(32)).astype(np.uint8)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    b = _lowered(np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8))
    starts = np.cumsum([1, *[len(r) + 1 for r in raw]])
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(b) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((b.astype(_U) + _U(1)) * power[: len(b)])])
    h = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(_U))
    return h, np.searchsorted(starts, first, side="right") - 1


def _long(word: str) -> np.ndarray:
    """The hash of one word, in pieces; the same as _hashed gives."""
    total = size = 0
    for at in range(0, len(word), SLICE):
        b = _lowered(np.frombuffer(word[at : at + SLICE].encode(), np.uint8))
        own = int(((b.astype(_U) + _U(1)) * _powers_to(len(b))[0][: len(b)]).sum(dtype=_U))
        total, size = (total + own * pow(_P, size, 1 << 64)) & (1 << 64) - 1, size + len(b)
    return mix(np.array([(total + size) & (1 << 64) - 1], _U))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text it is in), in order."""
    hashes, owners, held, of, size = [np.empty(0, _U)], [np.empty(0, np.int64)], [], [], 0

    def flush() -> None:
        nonlocal size
        if held:
            h, at = _hashed(held)
            hashes.append(h)
            owners.append(np.array(of)[at])
            held.clear()
            of.clear()
            size = 0

    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > SLICE:
                end = 1 + max(t.rfind(c, at, at + SLICE) for c in _BLANKS)
                if end <= at:  # a word of SLICE characters or more
                    flush()
                    found = _BLANK.search(t, at + SLICE)
                    end = found.start() if found else len(t)
                    hashes.append(_long(t[at:end]))
                    owners.append(np.array([i]))
                    at = end
                    continue
            if size + end - at > SLICE:
                flush()
            held.append(t[at:end])
            of.append(i)
            size += end - at
            at = end
    flush()
    return np.concatenate(hashes), np.concatenate(owners)
