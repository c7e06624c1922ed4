"""MacBinary, AppleSingle and BinHex: one file and, if present, its resource fork."""

from __future__ import annotations

import binascii

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..fields import be, mac_time, take


def _entries(fmt: str, name: bytes, data, rsrc, kind: bytes, creator: bytes, flags: int, created: int | None, changed: int | None, method: str) -> Archive:
    extra = {"wrapper": fmt, "macType": kind.decode("mac_roman"), "macCreator": creator.decode("mac_roman"), "finderFlags": f"0x{flags:04x}"}
    out = []
    if data is not None and (len(data()) or rsrc is None or not len(rsrc())):
        n = len(data())
        out.append(Entry(name, "file", n, n, changed, method=method, extra=dict(extra), read=data))
    if rsrc is not None and (n := len(rsrc())):
        out.append(Entry(name, "file", n, n, changed, method=method, extra=extra | {"fork": "rsrc"}, read=rsrc))
    return Archive(fmt, out)


def parse_macbinary(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 128)
    n, r = be(h, 83, 4), be(h, 87, 4)
    start = 128 + -(-be(h, 120, 2) // 128) * 128
    after = start + -(-n // 128) * 128
    data, rsrc = take(buf, start, n), take(buf, after, r)
    return _entries("macbinary", h[2 : 2 + h[1]], lambda: data, lambda: rsrc, h[65:69], h[69:73], h[73] << 8 | h[101], mac_time(be(h, 91, 4)), mac_time(be(h, 95, 4)), "MacBinary (stored)")


def parse_applesingle(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 26)
    parts = {}
    for i in range(be(h, 24, 2)):
        r = take(buf, 26 + 12 * i, 12)
        parts[be(r, 0, 4)] = take(buf, be(r, 4, 4), be(r, 8, 4))
    info = parts.get(9, b"").ljust(32, b"\0")
    dates = parts.get(8, b"")
    changed = (int.from_bytes(dates[4:8], "big", signed=True) + 946_684_800) * 1_000_000 if len(dates) >= 8 else None
    base = (name or "data").rsplit("/", 1)[-1]
    shown = parts.get(3) or base.encode()
    data = parts.get(1, b"")
    return _entries("applesingle", shown, lambda: data, (lambda: parts[2]) if 2 in parts else None, info[:4], info[4:8], be(info, 8, 2), None, changed, "AppleSingle (stored)")


#: The 64 characters of BinHex 4, in order.
HQX = "!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"


def unhqx(text: bytes) -> bytes:
    """BinHex characters to bytes, runs expanded."""
    start = text.index(b":") + 1
    stop = text.find(b":", start)
    if stop < 0:
        raise ArchiveError("truncated")
    value = {ord(c): i for i, c in enumerate(HQX)}
    hold = bits = 0
    raw = bytearray()
    for c in text[start:stop]:
        if c in b"\r\n\t ":
            continue
        if c not in value:
            raise malformed("BinHex character")
        hold, bits = hold << 6 | value[c], bits + 6
        if bits >= 8:
            bits -= 8
            raw.append(hold >> bits & 255)
            hold &= (1 << bits) - 1
    out, i = bytearray(), 0
    while i < len(raw):
        if raw[i] == 0x90:
            if i + 1 >= len(raw):
                raise ArchiveError("truncated")
            n = raw[i + 1]
            if n == 0:
                out.append(0x90)
            elif not out:
                raise malformed("BinHex run")
            else:
                out += bytes([out[-1]]) * (n - 1)
            i += 2
        else:
            out.append(raw[i])
            i += 1
    return bytes(out)


def parse_binhex(buf, name: str | None, opts: Options) -> Archive:
    b = bytes(buf)
    mark = b.find(b"(This file must be converted with BinHex")
    d = unhqx(b[b.index(b"\n", mark) if b.find(b"\n", mark) >= 0 else b.index(b"\r", mark) :])
    n = d[0]
    h = take(d, 1 + n, 21)
    size, rsize = be(h, 11, 4), be(h, 15, 4)
    if binascii.crc_hqx(d[: 20 + n], 0) != be(h, 19, 2) and binascii.crc_hqx(d[: 20 + n] + b"\0\0", 0) != be(h, 19, 2):
        raise malformed("BinHex header checksum")
    at = 22 + n

    def fork(start: int, length: int):
        def read() -> bytes:
            data = take(d, start, length)
            if length and binascii.crc_hqx(data, 0) != be(take(d, start + length, 2), 0, 2):
                raise ArchiveError("checksumMismatch", "BinHex fork")
            return data

        return read

    return _entries("binhex", d[1 : 1 + n], fork(at, size), fork(at + size + 2, rsize), h[1:5], h[5:9], be(h, 9, 2), None, None, "BinHex")
