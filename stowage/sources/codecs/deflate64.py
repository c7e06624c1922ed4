"""Deflate64: deflate with a 64 KiB window, longer matches and farther distances."""

from __future__ import annotations

from ...model import ArchiveError, malformed
from .huffman import Code, Lsb, copy_back

#: Fixed values of the format, as (first code, extra bits) rules: lengths from 257, distances from 0.
_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _steps(first: int, codes: int, each: int, plain: int) -> list[tuple[int, int]]:
    """(base, extra bits): `plain` codes without extra bits, then `each` codes for every number of them."""
    out, base = [], first
    for i in range(codes):
        extra = 0 if i < plain else (i - plain) // each + 1
        out.append((base, extra))
        base += 1 << extra
    return out


_LENGTHS = [*_steps(3, 28, 4, 8), (3, 16)]
_DISTANCES = _steps(1, 32, 2, 4)


def inflate64(data: bytes, limit: int | None = None) -> bytes:
    bits, out = Lsb(data), bytearray()
    while True:
        last, kind = bits.bits(1), bits.bits(2)
        if kind == 0:
            bits.align()
            n, check = bits.bits(16), bits.bits(16)
            if n ^ check != 0xFFFF:
                raise malformed("stored block length")
            out += bytes(bits.bits(8) for _ in range(n))
        elif kind == 3:
            raise malformed("deflate64 block type")
        else:
            if kind == 1:
                lit, dist = Code([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8, lsb=True), Code([5] * 32, lsb=True)
            else:
                nl, nd, nc = bits.bits(5) + 257, bits.bits(5) + 1, bits.bits(4) + 4
                lengths = [0] * 19
                for i in range(nc):
                    lengths[_ORDER[i]] = bits.bits(3)
                code, got = Code(lengths, lsb=True), []
                while len(got) < nl + nd:
                    s = code.read(bits)
                    if s < 16:
                        got.append(s)
                    elif s == 16:
                        if not got:
                            raise malformed("code length repeat")
                        got += [got[-1]] * (3 + bits.bits(2))
                    else:
                        got += [0] * (3 + bits.bits(3) if s == 17 else 11 + bits.bits(7))
                if len(got) > nl + nd:
                    raise malformed("code lengths")
                lit, dist = Code(got[:nl], lsb=True), Code(got[nl:], lsb=True)
            while (s := lit.read(bits)) != 256:
                if s < 256:
                    out.append(s)
                    continue
                if s > 285:
                    raise malformed("length code")
                base, extra = _LENGTHS[s - 257]
                count = base + bits.bits(extra)
                base, extra = _DISTANCES[dist.read(bits)]
                copy_back(out, base + bits.bits(extra), count)
                if limit is not None and len(out) > limit:
                    raise malformed("more output than declared")
        if bits.past():
            raise ArchiveError("truncated")
        if limit is not None and len(out) > limit:
            raise malformed("more output than declared")
        if last:
            return bytes(out)
