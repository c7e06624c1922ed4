"""WIM images: directory trees joined to the lookup table by SHA-1."""

from __future__ import annotations

import hashlib

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..codecs.lzx import decode_wim, decode_xpress
from ..fields import filetime, le, take


def _resource(b: bytes, at: int) -> tuple[int, int, int, int]:
    """(packed, flags, offset, size)."""
    return le(b, at, 7), b[at + 7], le(b, at + 8, 8), le(b, at + 16, 8)


def _unpacked(buf, r: tuple[int, int, int, int], method: str, chunk: int, opts: Options) -> bytes:
    packed, flags, at, size = r
    if size > opts.limits.max_in_memory:
        raise ArchiveError("limitExceeded", "WIM resource")
    data = take(buf, at, packed)
    if not flags & 4:
        if packed != size:
            raise malformed("WIM resource size")
        return data
    if flags & 16:
        raise ArchiveError("unsupportedMethod", "solid WIM resource")
    n = -(-size // chunk)
    width = 8 if size > 0xFFFFFFFF else 4
    places = [0] + [le(data, width * i, width) for i in range(n - 1)]
    base = width * (n - 1)
    out = []
    for i in range(n):
        part = data[base + places[i] : base + places[i + 1] if i + 1 < n else len(data)]
        want = min(chunk, size - i * chunk)
        if len(part) == want:
            out.append(part)
        elif method == "XPRESS":
            out.append(decode_xpress(part, want))
        elif method == "LZX":
            out.append(decode_wim(part, want, max(15, (chunk - 1).bit_length())))
        else:
            raise ArchiveError("unsupportedMethod", f"WIM {method}")
    return b"".join(out)


def parse(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 208)
    flags, chunk, part, parts = le(h, 16, 4), le(h, 20, 4) or 32768, le(h, 40, 2), le(h, 42, 2)
    if (part, parts) not in ((1, 1), (0, 0)):
        raise ArchiveError("unsupportedMethod", "spanned WIM")
    method = "stored" if not flags & 2 else "XPRESS" if flags & 0x20000 else "LZX" if flags & 0x40000 else "LZMS"
    table = _unpacked(buf, _resource(h, 48), method, chunk, opts)
    lookup: dict[bytes, tuple[int, int, int, int]] = {}
    images = []
    for at in range(0, len(table) - 49, 50):
        r = _resource(table, at)
        digest = table[at + 30 : at + 50]
        if r[1] & 2:
            images.append(r)
        else:
            lookup.setdefault(digest, r)
    entries: list[Entry] = []
    for i, r in enumerate(images):
        meta = _unpacked(buf, r, method, chunk, opts)
        if not meta:
            continue
        start = -(-max(8, le(meta, 0, 4)) // 8) * 8
        _tree(buf, meta, start, f"{i + 1}/" if len(images) > 1 else "", str(i + 1), lookup, method, chunk, entries, opts)
    return Archive("wim", entries)


def _tree(buf, meta: bytes, start: int, root: str, image: str, lookup, method: str, chunk: int, entries: list[Entry], opts: Options) -> None:
    stack, seen = [(le(meta, start + 16, 8), root)], set()
    while stack:
        at, prefix = stack.pop()
        if not at or at in seen:
            continue
        seen.add(at)
        below = []
        while at + 8 <= len(meta) and (n := le(meta, at, 8)) > 8:
            d = meta[at : at + n]
            attr, child, tag, streams = le(d, 8, 4), le(d, 16, 8), le(d, 88, 4), le(d, 96, 2)
            short, long = le(d, 98, 2), le(d, 100, 2)
            text = d[102 : 102 + long].decode("utf-16-le", "replace")
            digest = d[64:84]
            path = prefix + text
            at += -(-n // 8) * 8
            for _ in range(streams):
                m = le(meta, at, 8)
                s = meta[at : at + m]
                if digest == bytes(20) and le(s, 36, 2) == 0:
                    digest = s[16:36]
                at += -(-m // 8) * 8
            del short
            folder = bool(attr & 16) and not attr & 0x400
            r = lookup.get(digest)
            extra = {"attributes": f"0x{attr:08x}"}
            if len(root):
                extra["image"] = image
            if attr & 2:
                extra["hidden"] = "true"
            kind = "directory" if folder else "file"
            if attr & 0x400:
                extra["reparseTag"] = f"0x{tag:08x}"
                kind = "symlink" if tag in (0xA000000C, 0xA0000003) else "other"
            elif not folder and (group := le(d, 88, 8)):
                extra["hardLinkGroup"] = str(group)
            if digest != bytes(20):
                extra["sha1"] = digest.hex()
            if r is None and not folder and digest != bytes(20):
                raise malformed("WIM stream missing")
            size = r[3] if r else 0

            def read(r=r, digest=digest, kind=kind) -> bytes:
                if r is None:
                    return b""
                out = _unpacked(buf, r, method, chunk, opts)
                if hashlib.sha1(out).digest() != digest:
                    raise ArchiveError("checksumMismatch", "WIM SHA-1")
                return out

            e = Entry(path.encode("utf-8", "replace"), kind, 0 if folder else size, r[0] if r else 0, filetime(le(d, 56, 8)), method=f"WIM ({method})" if r and r[1] & 4 else "WIM (stored)", declared="utf-8", dir_hint=folder, extra=extra, read=read)
            if kind == "symlink" and r is not None:
                raw = read()
                if len(raw) >= 8:
                    base = 12 if tag == 0xA000000C else 8
                    o, m = le(raw, 0, 2), le(raw, 2, 2)
                    target = raw[base + o : base + o + m].decode("utf-16-le", "replace")
                    extra["linkPath"] = target.replace("\\", "/")
                    extra["linkTargetAbsolute"] = str(target[1:2] == ":" or target.startswith("\\")).lower()
            entries.append(e)
            if len(entries) > opts.limits.max_entries:
                raise ArchiveError("limitExceeded", "WIM entry count")
            if folder:
                below.append((child, f"{path}/"))
        stack += reversed(below)
