"""ARJ archives."""

from __future__ import annotations

import zlib

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..codecs.lha import static
from ..fields import dos_time, le, take


def _header(buf, at: int) -> tuple[bytes, int] | None:
    h = take(buf, at, 4)
    if h[:2] != b"\x60\xea":
        raise malformed("ARJ header id")
    n = le(h, 2, 2)
    if n == 0:
        return None
    if n > 2600:
        raise malformed("ARJ header size")
    body = take(buf, at + 4, n)
    if zlib.crc32(body) != le(take(buf, at + 4 + n, 4), 0, 4):
        raise malformed("ARJ header checksum")
    at += 8 + n
    while (x := le(take(buf, at, 2), 0, 2)) != 0:
        at += 2 + x + 4
    return body, at + 2


def fastest(data: bytes, size: int) -> bytes:
    """Method 4 is listed but not decoded."""
    raise ArchiveError("unsupportedMethod", "ARJ method 4")


def parse(buf, name: str | None, opts: Options) -> Archive:
    main = _header(buf, 0)
    if main is None:
        raise malformed("ARJ main header")
    _, at = main
    entries = []
    while (got := _header(buf, at)) is not None:
        h, data = got
        first = h[0]
        flags, method, kind = h[4], h[5], h[6]
        packed, size, crc, stamp, attr = le(h, 12, 4), le(h, 16, 4), le(h, 20, 4), le(h, 8, 4), le(h, 26, 2)
        rest = h[first:]
        raw, _, tail = rest.partition(b"\0")
        comment = tail.split(b"\0", 1)[0]
        after = data + packed
        if after > len(buf):
            raise ArchiveError("truncated")
        at = after
        if kind not in (0, 1, 3):
            continue
        shown = raw if flags & 0x10 else raw.replace(b"\\", b"/")
        host = h[3]
        extra = {"hostOS": str(host), "archiverVersion": str(h[1])}
        if kind == 1:
            extra["textMode"] = "true"
        if flags & 4:
            extra["continuesInNextVolume"] = "true"
        if comment:
            extra["comment"] = comment.decode("cp437")
        folder = kind == 3
        label = {0: "stored", 1: "method 1", 2: "method 2", 3: "method 3", 4: "method 4"}.get(method, f"method {method}")
        stored = take(buf, data, packed)

        def read(method=method, flags=flags, stored=stored, size=size, crc=crc) -> bytes:
            if flags & 1:
                raise ArchiveError("unsupportedMethod", "garbled ARJ entry")
            if flags & 12:
                raise ArchiveError("unsupportedMethod", "multi-volume ARJ entry")
            if method == 0:
                out = stored
            elif method in (1, 2, 3):
                out = static(stored, size, 26624, 5)
            else:
                out = fastest(stored, size)
            if len(out) != size:
                raise ArchiveError("truncated")
            if zlib.crc32(out) != crc:
                raise ArchiveError("checksumMismatch", "CRC-32")
            return out

        entries.append(Entry(shown, "directory" if folder else "file", 0 if folder else size, 0 if folder else packed, dos_time(stamp >> 16, stamp & 0xFFFF, opts.timezone), attr & 0o7777 if host == 2 else None, bool(flags & 1), crc=None if folder else crc, method=f"ARJ ({label})", dir_hint=folder, extra=extra, read=(lambda: b"") if folder else read))
    return Archive("arj", entries)
