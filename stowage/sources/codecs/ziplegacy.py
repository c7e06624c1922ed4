"""The ZIP methods of the first years: shrink, reduce, implode."""

from __future__ import annotations

from ...model import ArchiveError, malformed
from .huffman import Code, Lsb


def unshrink(data: bytes, size: int) -> bytes:
    """LZW of 9 to 13 bits; code 256 announces a wider code (1) or a partial clearing (2)."""
    bits, out = Lsb(data), bytearray()
    prefix, last = [0] * 8192, [0] * 8192
    used = bytearray(b"\1" * 257 + b"\0" * 7935)
    width, prev, first, free = 9, -1, 0, 257
    while len(out) < size:
        code = bits.bits(width)
        if bits.past():
            raise ArchiveError("truncated")
        if code == 256:
            what = bits.bits(width)
            if what == 1:
                width += 1
                if width > 13:
                    raise malformed("shrink code width")
            elif what == 2:
                parents = bytearray(8192)
                for c in range(257, 8192):
                    if used[c]:
                        parents[prefix[c]] = 1
                for c in range(257, 8192):
                    if used[c] and not parents[c]:
                        used[c] = 0
                free = 257
            else:
                raise malformed("shrink control code")
            continue
        if prev < 0:
            if code > 255:
                raise malformed("shrink first code")
            out.append(code)
            prev, first = code, code
            continue
        while free < 8192 and used[free]:
            free += 1
        walk, stack = code, []
        if not used[code]:
            stack.append(first)
            walk = prev
        steps = 0
        while walk > 255:
            stack.append(last[walk])
            walk = prefix[walk]
            steps += 1
            if steps > 8192:
                raise malformed("shrink cycle")
        stack.append(walk)
        first = walk
        out += bytes(reversed(stack))
        if free < 8192:
            prefix[free], last[free], used[free] = prev, first, 1
        prev = code
    return bytes(out[:size])


def reduce(data: bytes, size: int, factor: int) -> bytes:
    """Followers of each byte, then runs behind the escape 144."""
    bits = Lsb(data)
    followers: list[list[int]] = [[] for _ in range(256)]
    for c in range(255, -1, -1):
        followers[c] = [bits.bits(8) for _ in range(bits.bits(6))]
    out, before, state, length, v = bytearray(), 0, 0, 0, 0
    low = (1 << 8 - factor) - 1
    while len(out) < size:
        own = followers[before]
        if not own or bits.bits(1):
            c = bits.bits(8)
        else:
            n = max(1, (len(own) - 1).bit_length())
            k = bits.bits(n)
            if k >= len(own):
                raise malformed("reduce follower")
            c = own[k]
        before = c
        if bits.past():
            raise ArchiveError("truncated")
        if state == 0:
            if c == 144:
                state = 1
            else:
                out.append(c)
        elif state == 1:
            if c == 0:
                out.append(144)
                state = 0
            else:
                v = c
                length = v & low
                state = 2 if length == low else 3
        elif state == 2:
            length += c
            state = 3
        else:
            back = (v >> 8 - factor) * 256 + c + 1
            for _ in range(length + 3):
                out.append(out[-back] if back <= len(out) else 0)
            state = 0
    return bytes(out[:size])


def _tree(bits: Lsb, count: int) -> Code:
    """Lengths as (length - 1, repeats - 1) pairs; codes are read inverted, most significant bit first."""
    got: list[int] = []
    for _ in range(bits.bits(8) + 1):
        b = bits.bits(8)
        got += [(b & 15) + 1] * ((b >> 4) + 1)
    if len(got) != count:
        raise malformed("implode tree")
    return _Inverted(got)


class _Inverted:
    """Shannon-Fano codes: ordered by length, the longest get the least codes."""

    def __init__(self, lengths: list[int]):
        order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
        code = step = last = 0
        self.find: dict[tuple[int, int], int] = {}
        for i in reversed(order):
            code += step
            if lengths[i] != last:
                last = lengths[i]
                step = 1 << 16 - last
            self.find[last, code >> 16 - last] = i

    def read(self, bits: Lsb) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | bits.bits(1)
            if (n, v) in self.find:
                return self.find[n, v]
        raise malformed("implode code")


def explode(data: bytes, size: int, flags: int) -> bytes:
    big, literals = bool(flags & 2), bool(flags & 4)
    bits, out = Lsb(data), bytearray()
    lit = _tree(bits, 256) if literals else None
    length, far = _tree(bits, 64), _tree(bits, 64)
    low, least = 7 if big else 6, 3 if literals else 2
    while len(out) < size:
        if bits.bits(1):
            out.append(lit.read(bits) if lit else bits.bits(8))
        else:
            back = bits.bits(low)
            back |= far.read(bits) << low
            n = length.read(bits)
            if n == 63:
                n += bits.bits(8)
            for _ in range(n + least):
                out.append(out[-back - 1] if back < len(out) else 0)
        if bits.past():
            raise ArchiveError("truncated")
    return bytes(out[:size])
