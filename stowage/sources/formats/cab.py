"""Microsoft cabinets: stored, MSZIP and LZX folders; Quantum and continued files list only."""

from __future__ import annotations

import zlib

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..fields import dos_time, le, take


def _checksum(data: bytes, seed: int) -> int:
    c = seed
    n = len(data) // 4 * 4
    for i in range(0, n, 4):
        c ^= int.from_bytes(data[i : i + 4], "little")
    rest = data[n:]
    if rest:
        c ^= int.from_bytes(rest, "big")
    return c


def parse(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 36)
    if h[:4] != b"MSCF":
        raise malformed("cabinet header")
    first, folders, files, flags = le(h, 16, 4), le(h, 26, 2), le(h, 28, 2), le(h, 30, 2)
    at, skip_folder, skip_data = 36, 0, 0
    if flags & 4:
        r = take(buf, 36, 4)
        at, skip_folder, skip_data = 40 + le(r, 0, 2), r[2], r[3]
    for bit in (1, 2):
        if flags & bit:
            for _ in range(2):
                end = bytes(buf[at : at + 512]).find(b"\0")
                if end < 0:
                    raise malformed("cabinet name")
                at += end + 1
    if files > opts.limits.max_records:
        raise ArchiveError("limitExceeded", "cabinet entry count")
    listed = []
    for _ in range(folders):
        r = take(buf, at, 8)
        listed.append((le(r, 0, 4), le(r, 4, 2), le(r, 6, 2)))
        at += 8 + skip_folder
    held: dict[int, bytes] = {}

    def folder(i: int) -> bytes:
        if i not in held:
            held.clear()
            held[i] = _unpacked(buf, *listed[i], skip_data, opts)
        return held[i]

    at, entries = first, []
    for _ in range(files):
        r = take(buf, at, 16)
        size, start, number, date, time, attr = le(r, 0, 4), le(r, 4, 4), le(r, 8, 2), le(r, 10, 2), le(r, 12, 2), le(r, 14, 2)
        tail = bytes(buf[at + 16 : at + 16 + 1024])
        end = tail.find(b"\0")
        if end < 0:
            raise malformed("cabinet file name")
        at += 17 + end
        continued = number >= 0xFFFD
        own = {0xFFFD: 0, 0xFFFE: len(listed) - 1, 0xFFFF: 0}.get(number, number)
        if own >= len(listed):
            raise malformed("cabinet folder index")
        kind = listed[own][2] & 15
        method = {0: "stored", 1: "MSZIP", 2: "Quantum", 3: "LZX"}.get(kind, f"method {kind}")
        extra = {"folder": str(own), "attributes": f"0x{attr:04x}", "setID": str(le(h, 32, 2)), "cabinetIndex": str(le(h, 34, 2))}
        if continued:
            extra["continued"] = "true"

        def read(own=own, start=start, size=size, continued=continued, kind=kind, method=method) -> bytes:
            if continued:
                raise ArchiveError("unsupportedMethod", "file continues in another cabinet")
            if kind not in (0, 1, 3):
                raise ArchiveError("unsupportedMethod", method)
            data = folder(own)
            if start + size > len(data):
                raise ArchiveError("truncated")
            return data[start : start + size]

        shown = tail[:end].replace(b"\\", b"/")
        entries.append(Entry(shown, "file", size, None, dos_time(date, time, opts.timezone), solid=own, method=f"cab ({method})", declared="utf-8" if attr & 0x80 else None, extra=extra, read=read))
    return Archive("cab", entries)


def _unpacked(buf, at: int, blocks: int, kind: int, skip: int, opts: Options) -> bytes:
    out, pieces, sizes = bytearray(), [], []
    for _ in range(blocks):
        r = take(buf, at, 8)
        check, packed, size = le(r, 0, 4), le(r, 4, 2), le(r, 6, 2)
        data = take(buf, at + 8 + skip, packed)
        if check and _checksum(take(buf, at + 4, 4 + skip) if skip else r[4:8], _checksum(data, 0)) != check:
            raise ArchiveError("checksumMismatch", "cabinet block")
        at += 8 + skip + packed
        if kind & 15 == 0:
            out += data
        elif kind & 15 == 1:
            if data[:2] != b"CK":
                raise malformed("MSZIP block")
            d = zlib.decompressobj(-15, zdict=bytes(out[-32768:])) if out else zlib.decompressobj(-15)
            try:
                got = d.decompress(data[2:])
            except zlib.error as e:
                raise malformed(f"MSZIP: {e}") from None
            if len(got) != size:
                raise malformed("MSZIP block size")
            out += got
        else:
            pieces.append(data)
            sizes.append(size)
    if kind & 15 == 3:
        from ..codecs.lzx import decode_cab

        return decode_cab(b"".join(pieces), sum(sizes), kind >> 8 & 31)
    return bytes(out)
