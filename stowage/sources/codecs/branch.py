"""Branch and delta filters of 7z and xz that the library lacks, BCJ2 and byte swaps."""

from __future__ import annotations

from ...model import malformed


def delta(data: bytes, distance: int) -> bytes:
    """Each byte is a difference to the one `distance` before."""
    out = bytearray(data)
    for lane in range(distance):
        total = 0
        for i in range(lane, len(out), distance):
            total = total + out[i] & 255
            out[i] = total
    return bytes(out)


def swap(data: bytes, width: int) -> bytes:
    """Reverses the bytes of each whole unit of 2 or 4."""
    n = len(data) // width * width
    out = bytearray(data)
    for i in range(width):
        out[i:n:width] = data[width - 1 - i : n : width]
    return bytes(out)


def arm64(data: bytes, start: int = 0) -> bytes:
    """Absolute BL and ADRP targets back to relative ones."""
    out = bytearray(data)
    for i in range(0, len(out) - 3, 4):
        pc, word = start + i, int.from_bytes(out[i : i + 4], "little")
        if word >> 26 == 0x25:
            word = 0x94000000 | (word - (pc >> 2)) & 0x03FFFFFF
        elif word & 0x9F000000 == 0x90000000:
            src = word >> 29 & 3 | word >> 3 & 0x1FFFFC
            if (src + 0x020000) & 0x1C0000:
                continue
            dest = src - (pc >> 12)
            word = word & 0x9000001F | (dest & 3) << 29 | (dest & 0x3FFFC) << 3 | -(dest & 0x020000) & 0xE00000
        else:
            continue
        out[i : i + 4] = (word & 0xFFFFFFFF).to_bytes(4, "little")
    return bytes(out)


def riscv(data: bytes, start: int = 0) -> bytes:
    """Targets of JAL and of AUIPC pairs become relative again."""
    out, i, word = bytearray(data), 0, lambda at: int.from_bytes(out[at : at + 4], "little")
    while i + 8 <= len(out):
        first, here = out[i], start + i
        if first == 0xEF and not out[i + 1] & 0x0D:
            a, b, c = out[i + 1 : i + 4]
            to = ((a & 0xF0) << 13 | b << 9 | c << 1) - here & 0xFFFFFFFF
            out[i + 1 : i + 4] = bytes([a & 15 | to >> 8 & 0xF0, to >> 16 & 15 | to >> 7 & 16 | to << 4 & 0xE0, to >> 4 & 0x7F | to >> 13 & 0x80])
            i += 4
        elif first & 0x7F == 0x17:
            one, two = word(i), word(i + 4)
            if one & 0xE80:
                if (one << 8 ^ two) & 0xF8003 != 3:
                    i += 6
                    continue
                to = (one & 0xFFFFF000) + (two >> 20)
                one, two = 0x17 | 2 << 7 | two << 12, to
            else:
                register = one >> 27
                if (one - 0x3117 << 18) & 0xFFFFFFFF >= register & 0x1D:
                    i += 4
                    continue
                to = int.from_bytes(out[i + 4 : i + 8], "big") - here
                one, two = 0x17 | register << 7 | to + 0x800 & 0xFFFFF000, one >> 12 | to << 20
            out[i : i + 8] = (one & 0xFFFFFFFF).to_bytes(4, "little") + (two & 0xFFFFFFFF).to_bytes(4, "little")
            i += 8
        else:
            i += 2
    return bytes(out)


class _Range:
    """The binary range decoder that BCJ2 shares with LZMA."""

    def __init__(self, data: bytes):
        if len(data) < 5:
            raise malformed("bcj2 range stream")
        self.data, self.at, self.range, self.code = data, 5, 0xFFFFFFFF, int.from_bytes(data[1:5], "big")
        self.odds = [1024] * 258

    def bit(self, slot: int) -> int:
        if self.range < 1 << 24:
            self.range = self.range << 8 & 0xFFFFFFFF
            self.code = (self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.at += 1
        p = self.odds[slot]
        bound = (self.range >> 11) * p
        if self.code < bound:
            self.range = bound
            self.odds[slot] = p + (2048 - p >> 5)
            return 0
        self.range -= bound
        self.code -= bound
        self.odds[slot] = p - (p >> 5)
        return 1


def bcj2(main: bytes, call: bytes, jump: bytes, ranges: bytes, size: int) -> bytes:
    """x86 branch targets from streams of their own."""
    rc, out = _Range(ranges), bytearray()
    prev, at, calls, jumps = 0, 0, 0, 0
    while len(out) < size:
        if at >= len(main):
            raise malformed("bcj2 main stream")
        b = main[at]
        at += 1
        out.append(b)
        if len(out) == size:
            break
        if b & 0xFE == 0xE8 or prev == 0x0F and b & 0xF0 == 0x80:
            slot = prev if b == 0xE8 else 256 if b == 0xE9 else 257
            if rc.bit(slot):
                if b == 0xE8:
                    raw, calls = call[calls : calls + 4], calls + 4
                else:
                    raw, jumps = jump[jumps : jumps + 4], jumps + 4
                if len(raw) < 4:
                    raise malformed("bcj2 branch stream")
                target = (int.from_bytes(raw, "big") - (len(out) + 4)) & 0xFFFFFFFF
                out += target.to_bytes(4, "little")
                prev = out[-1]
                continue
        prev = b
    return bytes(out[:size])
