"""UDF volumes: physical, sparable and metadata partitions."""

from __future__ import annotations

import unicodedata
from datetime import datetime, timedelta, timezone

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..fields import le, take


def _tag(b: bytes) -> int:
    """The id of a descriptor whose tag checksum holds, else 0."""
    if len(b) < 16 or (sum(b[:16]) - b[4]) & 255 != b[4]:
        return 0
    return le(b, 0, 2)


def _time(b: bytes) -> int | None:
    zone = le(b, 0, 2) & 0xFFF
    zone = zone - 4096 if zone > 2047 else zone
    try:
        when = datetime(le(b, 2, 2), *b[4:9], tzinfo=timezone(timedelta(minutes=zone if -1440 < zone < 1440 else 0)))
    except ValueError:
        return None
    return int(when.timestamp()) * MICRO + b[9] * 10_000 + b[10] * 100 + b[11]


def _text(b: bytes) -> str:
    """Compressed Unicode, in composed form."""
    if not b:
        return ""
    if b[0] in (8, 254):
        return unicodedata.normalize("NFC", b[1:].decode("latin-1"))
    if b[0] in (16, 255):
        return unicodedata.normalize("NFC", b[1:].decode("utf-16-be", "replace"))
    raise malformed("UDF name compression")


class Volume:
    def __init__(self, buf):
        self.buf = buf
        for self.block in (2048, 512, 4096):
            for at in (256, len(buf) // self.block - 1, len(buf) // self.block - 257):
                d = bytes(buf[at * self.block : (at + 1) * self.block]) if at > 0 else b""
                if _tag(d) == 2 and le(d, 12, 4) == at:
                    break
            else:
                continue
            break
        else:
            raise malformed("no UDF anchor")
        starts: dict[int, int] = {}
        logical = None
        for i in range(le(d, 16, 4) // self.block):
            v = take(buf, (le(d, 20, 4) + i) * self.block, self.block)
            kind = _tag(v)
            if kind == 5:
                starts.setdefault(le(v, 22, 2), le(v, 188, 4))
            elif kind == 6 and logical is None:
                logical = v
            elif kind == 8:
                break
        if logical is None or le(logical, 212, 4) != self.block:
            raise malformed("no UDF logical volume")
        self.maps: list = []
        at = 440
        for _ in range(le(logical, 268, 4)):
            kind, n = logical[at], logical[at + 1]
            m = logical[at : at + n]
            if kind == 1:
                self.maps.append(starts[le(m, 4, 2)])
            elif b"*UDF Metadata Partition" in m[4:36]:
                self.maps.append((len(self.maps), starts[le(m, 38, 2)], le(m, 40, 4)))
            elif b"*UDF Sparable Partition" in m[4:36]:
                self.maps.append(starts[le(m, 38, 2)])
            else:
                raise ArchiveError("unsupportedMethod", "UDF virtual partition")
            at += max(2, n)
        self.meta: dict[int, list[tuple[int, int]]] = {}
        root = self.long_ad(logical[248:264])
        fsd = self.read(*root)
        if _tag(fsd) != 256:
            raise malformed("UDF file set")
        self.root = self.long_ad(fsd[400:416])

    @staticmethod
    def long_ad(b: bytes) -> tuple[int, int, int]:
        """(partition, block, length)."""
        return le(b, 8, 2), le(b, 4, 4), le(b, 0, 4) & 0x3FFFFFFF

    def place(self, part: int, block: int) -> int:
        """Byte offset of a block of a partition."""
        if part >= len(self.maps):
            raise malformed("UDF partition")
        m = self.maps[part]
        if isinstance(m, int):
            return (m + block) * self.block
        if part not in self.meta:
            icb = take(self.buf, (m[1] + m[2]) * self.block, self.block)
            self.meta[part] = [((m[1] + b) * self.block, n) for _, b, n, kind in self.extents(icb, 0)[0] if kind == 0]
        at = block * self.block
        for start, n in self.meta[part]:
            if at < n:
                return start + at
            at -= n
        raise malformed("UDF metadata block")

    def read(self, part: int, block: int, size: int) -> bytes:
        out = b""
        while len(out) < size:  # neighbouring blocks of a metadata file may lie apart
            n = min(self.block - len(out) % self.block, size - len(out)) if not isinstance(self.maps[part], int) else size
            out += take(self.buf, self.place(part, block + len(out) // self.block), n)
        return out

    def extents(self, icb: bytes, part: int) -> tuple[list[tuple[int, int, int, int]], bytes | None]:
        """(partition, block, length, kind) of a file, or its embedded bytes."""
        wide = _tag(icb) == 266
        if _tag(icb) not in (261, 266):
            raise malformed("UDF file entry")
        ea, n = (le(icb, 208, 4), le(icb, 212, 4)) if wide else (le(icb, 168, 4), le(icb, 172, 4))
        first = (216 if wide else 176) + ea
        form, data = le(icb, 34, 2) & 7, icb[first : first + n]
        if form == 3:
            return [], data[: le(icb, 56, 8)]
        size, out, at, chains = 8 if form == 0 else 16, [], 0, 0
        while at + size <= len(data):
            length = le(data, at, 4)
            block, p = le(data, at + 4, 4), le(data, at + 8, 2) if form else part
            at += size
            kind, length = length >> 30, length & 0x3FFFFFFF
            if not length:
                break
            if kind == 3:
                chains += 1
                more = self.read(p, block, length)
                if _tag(more) != 258 or chains > 10_000:
                    raise malformed("UDF allocation extent")
                data, at = more[24 : 24 + le(more, 20, 4)], 0
                continue
            out.append((p, block, length, kind))
        return out, None

    def content(self, icb: bytes, part: int, limit: int) -> bytes:
        size = le(icb, 56, 8)
        if size > limit:
            raise ArchiveError("limitExceeded", "UDF file size")
        pieces, inside = self.extents(icb, part)
        if inside is not None:
            return inside
        out = bytearray()
        for p, block, n, kind in pieces:
            out += self.read(p, block, n) if kind == 0 else bytes(n)
            if len(out) >= size:
                break
        return bytes(out[:size].ljust(size, b"\0"))


def _link(data: bytes) -> str:
    """A path from its components."""
    parts, at = [], 0
    while at + 4 <= len(data):
        kind, n = data[at], data[at + 1]
        raw = data[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 5:  # some writers leave the compression id out
            parts.append(_text(raw) if raw[:1] in (b"\x08", b"\x10") else raw.decode("utf-8", "replace"))
        elif kind:
            parts.append({1: "", 2: "", 3: "..", 4: "."}.get(kind, ""))
    return "/".join(parts)


def parse(buf, name: str | None, opts: Options) -> Archive:
    from .iso import _cooked

    buf = _cooked(buf)
    v = Volume(buf)
    entries: list[Entry] = []
    stack, seen, paths, skipped = [(v.root, "")], set(), set(), 0
    while stack:
        (part, block, _), prefix = stack.pop()
        if (part, block) in seen:
            continue
        seen.add((part, block))
        icb = v.read(part, block, v.block)
        data, at, below = v.content(icb, part, opts.limits.max_total_metadata), 0, []
        while at + 38 <= len(data):
            d = data[at:]
            if _tag(d) != 257:
                raise malformed("UDF directory entry")
            flags, n, extra_n = d[18], d[19], le(d, 36, 2)
            at += -(-(38 + n + extra_n) // 4) * 4
            if flags & 12:
                continue
            to = v.long_ad(d[20:36])
            text = _text(d[38 + extra_n : 38 + extra_n + n]).replace("/", ":")
            path = prefix + text
            if path in paths:
                skipped += 1
                continue
            paths.add(path)
            own = v.read(to[0], to[1], v.block)
            wide = _tag(own) == 266
            kind = {4: "directory", 5: "file", 12: "symlink"}.get(own[27], "file" if own[27] in (0, 249) else "other")
            bits = le(own, 44, 4)
            mode = (bits & 7) | (bits >> 5 & 7) << 3 | (bits >> 10 & 7) << 6
            size = le(own, 56, 8)
            extra = {"uid": str(le(own, 36, 4)), "gid": str(le(own, 40, 4)), "fileSystem": "UDF", "nameSource": "udf"}
            if flags & 1:
                extra["hidden"] = "true"
            read = lambda own=own, p=to[0]: v.content(own, p, opts.limits.max_entry_size)
            if kind == "symlink":
                extra["linkPath"] = _link(read())
                read = lambda to=extra["linkPath"].encode(): to
            e = Entry(path.encode("utf-8", "replace"), kind, size if kind in ("file", "symlink") else 0, size if kind in ("file", "symlink") else 0, _time(own[92:104] if wide else own[84:96]), mode, method="UDF (stored)", declared="utf-8", dir_hint=kind == "directory", extra=extra, read=read)
            entries.append(e)
            if len(entries) > opts.limits.max_entries:
                raise ArchiveError("limitExceeded", "UDF entry count")
            if kind == "directory":
                below.append((to, f"{path}/"))
        stack += reversed(below)
    return Archive("udf", entries, extra={"skippedOlderVersions": str(skipped)} if skipped else {})
