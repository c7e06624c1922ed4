"""LHA/LZH archives, header levels 0 to 3."""

from __future__ import annotations

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..codecs import lha as codec
from ..fields import dos_time, filetime, le, take

_WINDOWS = {"lh4": (12, 4), "lh5": (13, 4), "lh6": (15, 5), "lh7": (16, 5), "lhx": (20, 5)}


def _crc16(data: bytes) -> int:
    from ...functions.sql import crc16

    return crc16(data)


def _extended(buf, at: int, size: int, width: int) -> tuple[list[tuple[int, bytes]], int]:
    """Extended headers from a place on, and the place after them."""
    out = []
    while size:
        if size < width + 1:
            raise malformed("LHA extended header")
        d = take(buf, at, size)
        out.append((d[0], d[1 : size - width]))
        at += size
        size = le(d, len(d) - width, width)
    return out, at


def parse(buf, name: str | None, opts: Options) -> Archive:
    at, entries = 0, []
    while at < len(buf) and buf[at]:
        try:
            e, at = _member(buf, at, opts)
        except ArchiveError as err:
            if opts.recover and entries and err.code in ("truncated", "malformed"):
                break
            raise
        if e is not None:
            entries.append(e)
        if len(entries) > opts.limits.max_entries:
            raise ArchiveError("limitExceeded", "LHA entry count")
    return Archive("lha", entries)


def _member(buf, at: int, opts: Options) -> tuple[Entry | None, int]:
    h = take(buf, at, 22)
    level, method = h[20], h[3:6].decode("latin-1")
    packed, size, stamp, attr = le(h, 7, 4), le(h, 11, 4), le(h, 15, 4), h[19]
    extended: list[tuple[int, bytes]] = []
    raw, crc, os_id = b"", None, ""
    if level in (0, 1):
        n = h[0] + 2
        d = take(buf, at, n)
        if sum(d[2:]) & 255 != d[1]:
            raise malformed("LHA header checksum")
        name_n = d[21]
        raw, p = d[22 : 22 + name_n], 22 + name_n
        crc = le(d, p, 2) if p + 2 <= n else None
        p += 2
        os_id = chr(d[p]) if p < n else ""
        data = at + n
        if level == 1:
            extended, data = _extended(buf, at + n, le(d, n - 2, 2), 2)
            packed -= data - (at + n)
    elif level == 2:
        crc, os_id = le(h, 21, 2) if False else le(take(buf, at, 26), 21, 2), chr(take(buf, at, 26)[23])
        extended, _ = _extended(buf, at + 26, le(take(buf, at, 26), 24, 2), 2)
        data = at + le(h, 0, 2)
    elif level == 3:
        d = take(buf, at, 32)
        if le(d, 0, 2) != 4:
            raise malformed("LHA level 3 word size")
        crc, os_id = le(d, 21, 2), chr(d[23])
        extended, _ = _extended(buf, at + 32, le(d, 28, 4), 4)
        data = at + le(d, 24, 4)
    else:
        raise malformed("LHA header level")
    folder, mode, mtime, extra = b"", None, None, {"attribute": f"0x{attr:02x}", "headerLevel": str(level), "method": f"-{method}-"}
    if os_id:
        extra |= {"osID": os_id, "os": {"M": "MS-DOS", "U": "UNIX", "m": "Macintosh", "w": "Windows NT", "W": "Windows 95", "2": "OS/2", "X": "X68000", "J": "Java", "A": "Amiga", "H": "Human68K"}.get(os_id, os_id)}
    mtime = le(h, 15, 4) * MICRO if level >= 2 else dos_time(stamp >> 16, stamp & 0xFFFF, opts.timezone)
    declared = None
    for kind, body in extended:
        if kind == 0x01:
            raw = body
        elif kind == 0x02:
            folder = body.replace(b"\xff", b"/")
        elif kind == 0x41 and len(body) >= 24:
            mtime = filetime(le(body, 8, 8))
        elif kind == 0x42 and len(body) >= 16:
            packed, size = le(body, 0, 8), le(body, 8, 8)
        elif kind == 0x46 and len(body) >= 4:
            extra["codePage"] = str(le(body, 0, 4))
            declared = {65001: "utf-8", 932: "cp932"}.get(le(body, 0, 4), f"cp{le(body, 0, 4)}")
        elif kind == 0x50 and len(body) >= 2:
            mode = le(body, 0, 2)
        elif kind == 0x51 and len(body) >= 4:
            extra |= {"gid": str(le(body, 0, 2)), "uid": str(le(body, 2, 2))}
        elif kind == 0x54 and len(body) >= 4:
            mtime = le(body, 0, 4) * MICRO
        elif kind in (0x3F, 0x71):
            extra["comment"] = body.decode("utf-8", "replace")
    if level == 0 and os_id == "U":
        d = take(buf, at, h[0] + 2)
        p = 25 + d[21]
        if p + 11 <= len(d):
            mtime, mode = le(d, p + 1, 4) * MICRO, le(d, p + 5, 2)
            extra |= {"uid": str(le(d, p + 7, 2)), "gid": str(le(d, p + 9, 2))}
    if crc is not None:
        extra["dataCRC16"] = f"0x{crc:04x}"
    full = folder + (b"" if not folder or folder.endswith(b"/") else b"/") + raw
    short = data + packed > len(buf)
    if short and not opts.recover:
        raise ArchiveError("truncated")
    after = data + packed
    is_dir = method == "lhd"
    if not full and not is_dir:
        return None, after
    kind = "directory" if is_dir else "file"
    e = Entry(full, kind, size, packed, mtime, mode & 0o7777 if mode is not None else None, incomplete=short, method=f"-{method}-", declared=declared, dir_hint=is_dir, extra=extra)
    if is_dir and mode is not None and mode & 0o170000 == 0o120000 and b"|" in full:
        shown, _, target = full.partition(b"|")
        e.raw_name, e.kind, e.dir_hint = shown, "symlink", False
        e.links["linkPath"] = target
    # a byte of a two-byte character may equal a backslash, so text is split only after decoding
    if os_id in ("M", "w", "W", "2", "") and b"\\" in e.raw_name:
        from .. import names

        charset = declared or names.detect_archive([e.raw_name], opts.encoding, opts.language)
        e.name = names.resolve(e.raw_name, declared, charset, opts.encoding, opts.language).replace("\\", "/")
    if is_dir:
        e.read = lambda: b""
        return e, after
    stored = bytes(buf[data : min(after, len(buf))])

    def read() -> bytes:
        out = _decode(method, stored, size)
        if crc is not None and not short and _crc16(out) != crc:
            raise ArchiveError("checksumMismatch", "CRC-16")
        return out

    e.read = read
    return e, after


def _decode(method: str, data: bytes, size: int) -> bytes:
    if method in ("lh0", "lz4", "pm0"):
        if len(data) < size:
            raise ArchiveError("truncated")
        return data[:size]
    if method in _WINDOWS:
        bits, width = _WINDOWS[method]
        return codec.static(data, size, 1 << bits, width)
    if method == "lh1":
        return codec.adaptive(data, size)
    if method == "lzs":
        return codec.lzs(data, size)
    if method == "lz5":
        return codec.lz5(data, size)
    raise ArchiveError("unsupportedMethod", f"-{method}-")
