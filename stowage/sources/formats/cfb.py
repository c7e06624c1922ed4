"""Compound files (OLE2): storages and streams by an in-order walk of their trees; MSI names unpacked."""

from __future__ import annotations

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..fields import filetime, le, take

#: The 64 characters that MSI packs two to a code unit, in order.
_MSI = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._"
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF


def msi_name(text: str) -> str:
    out = []
    for c in text:
        v = ord(c)
        if 0x3800 <= v < 0x4800:
            v -= 0x3800
            out += [_MSI[v & 63], _MSI[v >> 6]]
        elif 0x4800 <= v < 0x4840:
            out.append(_MSI[v - 0x4800])
        elif v == 0x4840:
            out.append("!")
        elif v < 32:
            out.append(f"[{v}]")
        else:
            out.append(c)
    return "".join(out)


def parse(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 512)
    major, shift, mini_shift = le(h, 26, 2), le(h, 30, 2), le(h, 32, 2)
    if (major, shift) not in ((3, 9), (4, 12)) or mini_shift != 6 or le(h, 28, 2) != 0xFFFE:
        raise malformed("compound file header")
    size = 1 << shift
    sector = lambda i: take(buf, (i + 1) * size, size)
    many = len(buf) // size + 1
    fat_at = [le(h, 76 + 4 * i, 4) for i in range(109)]
    nxt, seen = le(h, 68, 4), 0
    while nxt < _END - 1 and seen <= many:
        d = sector(nxt)
        fat_at += [le(d, 4 * i, 4) for i in range(size // 4 - 1)]
        nxt, seen = le(d, size - 4, 4), seen + 1
    fat: list[int] = []
    for s in fat_at[: le(h, 44, 4)] if le(h, 44, 4) <= len(fat_at) else fat_at:
        if s < _END - 1:
            d = sector(s)
            fat += [le(d, 4 * i, 4) for i in range(size // 4)]

    def chain(start: int, table: list[int]) -> list[int]:
        out, marked = [], set()
        while start != _END:
            if start >= len(table) or start in marked:
                raise malformed("sector chain")
            marked.add(start)
            out.append(start)
            start = table[start]
        return out

    directory = b"".join(sector(s) for s in chain(le(h, 48, 4), fat))
    count = len(directory) // 128
    nodes = [directory[128 * i : 128 * i + 128] for i in range(count)]
    if not nodes or nodes[0][66] != 5:
        raise malformed("root storage")
    mini_fat: list[int] = []
    if le(h, 60, 4) < _END - 1:
        for s in chain(le(h, 60, 4), fat):
            d = sector(s)
            mini_fat += [le(d, 4 * i, 4) for i in range(size // 4)]
    cutoff, length = le(h, 56, 4), lambda n: le(n, 120, 8) if major == 4 else le(n, 120, 4)
    mini: list[bytes] = []

    def data_of(n: bytes) -> bytes:
        want, start = length(n), le(n, 116, 4)
        if not want:
            return b""
        if want > opts.limits.max_entry_size:
            raise ArchiveError("limitExceeded", "stream size")
        if want < cutoff:
            if not mini:
                mini.append(b"".join(sector(s) for s in chain(le(nodes[0], 116, 4), fat)) if length(nodes[0]) else b"")
            out = b"".join(mini[0][64 * s : 64 * s + 64] for s in chain(start, mini_fat))
        else:
            out = b"".join(sector(s) for s in chain(start, fat))
        if len(out) < want:
            raise ArchiveError("truncated")
        return out[:want]

    entries, used = [], {0}
    stack: list[tuple[int, str, bool]] = [(le(nodes[0], 76, 4), "", False)]
    while stack:
        i, prefix, expanded = stack.pop()
        if i >= _FREE:
            continue
        if i >= count:
            raise malformed("directory entry")
        n = nodes[i]
        if not expanded:
            if i in used:
                raise malformed("directory cycle")
            used.add(i)
            stack += [(le(n, 72, 4), prefix, False), (i, prefix, True), (le(n, 68, 4), prefix, False)]
            continue
        kind = n[66]
        if kind not in (1, 2):
            raise malformed("directory entry type")
        stored = n[: max(0, min(64, le(n, 64, 2)) - 2)].decode("utf-16-le", "replace")
        path = prefix + msi_name(stored).replace("/", "%2F")
        extra = {"storedName": stored}
        if kind == 1:
            extra["clsid"] = n[80:96].hex()
        created, changed = le(n, 100, 8), le(n, 108, 8)
        if created:
            extra["created"] = str(created)
        folder = kind == 1
        entries.append(Entry(path.encode("utf-8", "replace"), "directory" if folder else "file", 0 if folder else length(n), 0 if folder else length(n), filetime(changed) if changed else None, method="stored", declared="utf-8", dir_hint=folder, extra=extra, read=(lambda: b"") if folder else lambda n=n: data_of(n)))
        if folder:
            stack.append((le(n, 76, 4), f"{path}/", False))
    return Archive("cfb", entries)
