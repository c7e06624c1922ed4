"""Compiled HTML help (ITSF): the directory's listing chunks, stored and LZX sections."""

from __future__ import annotations

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..fields import le, take


def _number(b: bytes, at: int) -> tuple[int, int]:
    v = 0
    while True:
        if at >= len(b):
            raise malformed("CHM number")
        v = v << 7 | b[at] & 127
        at += 1
        if b[at - 1] < 128:
            return v, at


def parse(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 96)
    version = le(h, 4, 4)
    directory, length = le(h, 72, 8), le(h, 80, 8)
    if length > opts.limits.max_total_metadata:
        raise ArchiveError("limitExceeded", "CHM directory")
    content = le(h, 88, 8) if version >= 3 else directory + length
    d = take(buf, directory, length)
    if d[:4] != b"ITSP":
        raise malformed("CHM directory")
    head, size = le(d, 8, 4), le(d, 16, 4)
    found: dict[str, tuple[int, int, int]] = {}
    order = []
    for at in range(head, len(d) - size + 1, size):
        c = d[at : at + size]
        if c[:4] != b"PMGL":
            continue
        p, stop = 20, size - le(c, 4, 4)
        while p < stop:
            n, p = _number(c, p)
            text = c[p : p + n]
            section, p = _number(c, p + n)
            offset, p = _number(c, p)
            length_, p = _number(c, p)
            try:
                key = text.decode()
            except UnicodeDecodeError:
                raise malformed("CHM name") from None
            found[key] = (section, offset, length_)
            order.append(key)

    def stored(key: str) -> bytes | None:
        if key not in found or found[key][0] != 0:
            return None
        return take(buf, content + found[key][1], found[key][2])

    labels = ["Uncompressed"]
    if (listing := stored("::DataSpace/NameList")) and len(listing) >= 4:
        labels, p = [], 4
        for _ in range(le(listing, 2, 2)):
            n = le(listing, p, 2)
            labels.append(listing[p + 2 : p + 2 + 2 * n].decode("utf-16-le", "replace"))
            p += 4 + 2 * n
    held: dict[int, bytes] = {}

    def section_data(i: int) -> bytes:
        if i not in held:
            label = labels[i] if i < len(labels) else ""
            base = f"::DataSpace/Storage/{label}/"
            control, packed = stored(f"{base}ControlData"), stored(f"{base}Content")
            table = stored(f"{base}Transform/{{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}}/InstanceData/ResetTable")
            if label != "MSCompressed" or control is None or packed is None or table is None or control[4:8] != b"LZXC":
                raise ArchiveError("unsupportedMethod", f"CHM section {label}")
            unit = 32768 if le(control, 8, 4) == 2 else 1
            interval, window = le(control, 12, 4) * unit, le(control, 16, 4) * unit
            n, first = le(table, 4, 4), le(table, 12, 4)
            full = le(table, 16, 8)
            if full > opts.limits.max_in_memory:
                raise ArchiveError("limitExceeded", "CHM section")
            places = [le(table, first + 8 * k, 8) for k in range(n)]
            from ..codecs.lzx import decode_frames

            held[i] = decode_frames(packed, full, window.bit_length() - 1, interval, places)
        return held[i]

    entries = []
    for key in order:
        if not key.startswith("/") or key == "/":
            continue
        folder = key.endswith("/")
        parts = key[1:].rstrip("/").split("/")
        if any(x in ("", ".", "..") for x in parts):
            raise malformed("CHM path")
        section, offset, size_ = found[key]
        label = labels[section] if section < len(labels) else str(section)

        def read(section=section, offset=offset, size=size_) -> bytes:
            data = take(buf, content + offset, size) if section == 0 else section_data(section)[offset : offset + size]
            if len(data) < size:
                raise ArchiveError("truncated")
            return data

        entries.append(Entry("/".join(parts).encode(), "directory" if folder else "file", 0 if folder else size_, size_ if section == 0 and not folder else None, solid=section if section > 0 and not folder else -1, method="stored" if section == 0 else f"CHM ({label})", declared="utf-8", dir_hint=folder, extra={"section": str(section), "sectionName": label}, read=(lambda: b"") if folder else read))
    return Archive("chm", entries)
