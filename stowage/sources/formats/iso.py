"""ISO 9660 with Joliet, Rock Ridge and zisofs; raw CD sectors are unwrapped first."""

from __future__ import annotations

import zlib
from datetime import datetime, timedelta, timezone

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..fields import le, take


def _cooked(buf):
    """The user data of raw sectors, or the buffer itself."""
    if bytes(buf[32769:32774]) in (b"CD001", b"BEA01"):
        return buf
    for size, skip in ((2352, 16), (2352, 24), (2448, 16), (2448, 24), (2336, 8)):
        if bytes(buf[16 * size + skip + 1 : 16 * size + skip + 6]) in (b"CD001", b"BEA01"):
            b = bytes(buf)
            return b"".join(b[i + skip : i + skip + 2048] for i in range(0, len(b) - skip - 2047, size))
    raise malformed("no volume descriptor")


def _date(b: bytes) -> int | None:
    try:
        zone = timezone(timedelta(minutes=15 * int.from_bytes(b[6:7], "little", signed=True)))
        return int(datetime(1900 + b[0], *b[1:6], tzinfo=zone).timestamp()) * MICRO
    except (ValueError, OverflowError):
        return None


def _susp(data: bytes, buf, skip: int) -> dict[str, list[bytes]]:
    """System use fields by tag, continuations followed."""
    out: dict[str, list[bytes]] = {}
    todo, seen = [data[skip:]], 0
    while todo and seen < 64:
        seen += 1
        d, at = todo.pop(0), 0
        while at + 4 <= len(d) and d[at + 2] >= 4:
            tag, n = d[at : at + 2].decode("latin-1"), d[at + 2]
            body = d[at + 4 : at + n]
            if tag == "ST":
                break
            if tag == "CE" and len(body) >= 24:
                todo.append(bytes(buf[le(body, 0, 4) * 2048 + le(body, 8, 4) :][: le(body, 16, 4)]))
            else:
                out.setdefault(tag, []).append(body)
            at += n
    return out


def _rock_name(fields: dict[str, list[bytes]]) -> bytes | None:
    parts = fields.get("NM")
    return b"".join(p[1:] for p in parts) if parts else None


def _rock_link(fields: dict[str, list[bytes]]) -> bytes | None:
    parts = fields.get("SL")
    if not parts:
        return None
    out, joined = [], False
    for p in parts:
        at = 1
        while at + 2 <= len(p):
            flags, n = p[at], p[at + 1]
            text = {2: b".", 4: b"..", 8: b""}.get(flags & 14, p[at + 2 : at + 2 + n])
            if joined and out:
                out[-1] += text
            else:
                out.append(text)
            joined = bool(flags & 1)
            at += 2 + n
    link = b"/".join(out)
    return b"/" if link == b"" and out else link


def parse(buf, name: str | None, opts: Options) -> Archive:
    buf = _cooked(buf)
    primary = joliet = None
    for sector in range(16, 16 + 64):
        d = bytes(buf[sector * 2048 : sector * 2048 + 2048])
        if len(d) < 2048 or d[1:6] != b"CD001" or d[0] == 255:
            break
        if d[0] == 1 and primary is None:
            primary = d
        elif d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
            joliet = d
    if primary is None:
        raise malformed("no primary volume descriptor")
    block = le(primary, 128, 2)
    if block not in (512, 1024, 2048):
        raise malformed("logical block size")
    root = primary[156:190]
    dot = bytes(buf[le(root, 2, 4) * block :][:255])
    skip = 0
    fields = _susp(dot[34 : dot[0]], buf, 0) if dot and dot[0] > 34 else {}
    if "SP" in fields and len(fields["SP"][0]) >= 3:
        skip = fields["SP"][0][2]
    rock = "SP" in fields or "RR" in fields or "NM" in fields
    if rock:
        probe = _walk(buf, root, block, skip, "rockRidge", opts, 64)
        rock = any(e.extra["nameSource"] == "rockRidge" for e in probe[0])
    source = "rockRidge" if rock else "joliet" if joliet is not None else "iso9660"
    entries, skipped = _walk(buf, joliet[156:190] if source == "joliet" else root, block, skip, source, opts, opts.limits.max_entries)
    return Archive("iso", entries, extra={"skippedOlderVersions": str(skipped)} if skipped else {})


def _walk(buf, root: bytes, block: int, skip: int, source: str, opts: Options, most: int) -> tuple[list[Entry], int]:
    entries, stack, seen, paths, skipped = [], [(le(root, 2, 4), le(root, 10, 4), b"", 0)], set(), set(), 0
    while stack:
        at, size, prefix, depth = stack.pop()
        if (at, size) in seen or depth > opts.limits.max_components:
            continue
        seen.add((at, size))
        if size > opts.limits.max_metadata:
            raise ArchiveError("limitExceeded", "ISO directory size")
        d, p, below, extents = take(buf, at * block, size), 0, [], []
        while p < len(d):
            n = d[p]
            if n == 0:
                p = -(-(p + 1) // 2048) * 2048
                continue
            r = d[p : p + n]
            p += n
            if len(r) < 34 or 33 + r[32] > len(r):
                raise malformed("ISO directory record")
            ident = r[33 : 33 + r[32]]
            if ident in (b"\0", b"\1"):
                continue
            own = 33 + r[32] + (r[32] + 1) % 2
            where, length, flags = le(r, 2, 4) + r[1], le(r, 10, 4), r[25]
            if flags & 0x80:
                extents.append((where, length))
                continue
            pieces, extents = [*extents, (where, length)], []
            fields = _susp(r[own:], buf, skip) if source == "rockRidge" else {}
            if "RE" in fields:
                continue
            shown = _rock_name(fields) if source == "rockRidge" else None
            used = source
            if shown is None:
                if source == "joliet":
                    shown = ident.decode("utf-16-be", "replace").encode("utf-8", "replace")
                else:
                    shown, used = ident, "iso9660"
                base, _, version = shown.rpartition(b";")
                shown = (base if base and version.isdigit() else shown)
                if not flags & 2:
                    shown = shown.removesuffix(b".") if used == "iso9660" else shown
            kind, mode, extra = "directory" if flags & 2 else "file", None, {"nameSource": used}
            if "PX" in fields and len(fields["PX"][0]) >= 4:
                full = le(fields["PX"][0], 0, 4)
                mode = full & 0o7777
                kind = {0o120000: "symlink", 0o040000: "directory", 0o100000: "file"}.get(full & 0o170000, "other")
            if flags & 1:
                extra["hidden"] = "true"
            target = None
            if "CL" in fields:
                kind, child = "directory", le(fields["CL"][0], 0, 4)
                head = take(buf, child * block, 34)
                pieces = [(child, le(head, 10, 4))]
            e = Entry(prefix + shown, kind, sum(n for _, n in pieces) if kind == "file" else 0, sum(n for _, n in pieces) if kind == "file" else 0, _date(r[18:25]), mode, method="ISO 9660 (stored)", declared="utf-8" if used != "iso9660" and source == "joliet" else None, dir_hint=bool(flags & 2), extra=extra)
            if kind == "symlink" and (target := _rock_link(fields)) is not None:
                e.links["linkPath"] = target
            zf = fields.get("ZF")
            if zf and zf[0][:2] == b"pz" and len(zf[0]) >= 12:
                e.method, e.size = "zisofs (zlib)", le(zf[0], 4, 4)
                extra["zisofsBlockSize"] = str(1 << zf[0][3])
            e.read = _reader(buf, pieces, block, e.size if e.method.startswith("zisofs") else None)
            if e.raw_name in paths:
                skipped += 1
                continue
            paths.add(e.raw_name)
            entries.append(e)
            if len(entries) > most:
                if most == 64:
                    return entries, skipped
                raise ArchiveError("limitExceeded", "ISO entry count")
            if kind == "directory":
                below.append((*pieces[0], e.raw_name + b"/", depth + 1))
        stack += reversed(below)
    return entries, skipped


def _reader(buf, pieces: list[tuple[int, int]], block: int, unzip: int | None):
    def read() -> bytes:
        data = b"".join(take(buf, at * block, n) for at, n in pieces)
        if unzip is None:
            return data
        if data[:8] != b"\x37\xe4\x53\x96\xc9\xdb\xd6\x07":
            raise malformed("zisofs header")
        size, head, step = le(data, 8, 4), data[12] * 4, 1 << data[13]
        places = [le(data, head + 4 * i, 4) for i in range(-(-size // step) + 1)]
        out = []
        for i, (a, b) in enumerate(zip(places, places[1:])):
            want = min(step, size - i * step)
            try:
                out.append(zlib.decompress(data[a:b]) if b > a else b"\0" * want)
            except zlib.error as e:
                raise malformed(f"zisofs: {e}") from None
        return b"".join(out)

    return read
