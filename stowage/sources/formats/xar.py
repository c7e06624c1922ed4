"""xar archives: a compressed XML table of contents before a heap."""

from __future__ import annotations

import hashlib
import zlib
from datetime import datetime
from xml.etree import ElementTree

from ...model import MICRO, Archive, ArchiveError, Entry, Options, malformed
from ..codecs import bunzip2, unlzma, unxz
from ..fields import be, take


def parse(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 28)
    size, packed, full, kind = be(h, 4, 2), be(h, 8, 8), be(h, 16, 8), be(h, 24, 4)
    if max(packed, full) > opts.limits.max_total_metadata:
        raise ArchiveError("limitExceeded", "xar table of contents")
    raw = take(buf, size, packed)
    heap = size + packed
    try:
        d = zlib.decompressobj()
        toc = d.decompress(raw, full + 1)
    except zlib.error as e:
        raise malformed(f"xar table of contents: {e}") from None
    if len(toc) != full:
        raise malformed("xar table of contents size")
    if b"<!DOCTYPE" in toc or b"<!ENTITY" in toc:
        raise malformed("xar table of contents has a document type")
    try:
        root = ElementTree.fromstring(toc).find("toc")
    except ElementTree.ParseError as e:
        raise malformed(f"xar table of contents: {e}") from None
    if root is None:
        raise malformed("xar table of contents")
    if kind in (1, 2, 3, 4) and (sum_ := root.find("checksum")) is not None:
        style = {1: "sha1", 2: "md5", 3: "sha256", 4: "sha512"}[kind]
        if kind in (3, 4):
            style = (sum_.get("style") or style).replace("-", "").lower()
        where, n = int(sum_.findtext("offset", "0")), int(sum_.findtext("size", "0"))
        if hashlib.new(style, raw).digest() != take(buf, heap + where, n):
            raise ArchiveError("checksumMismatch", "xar table of contents")
    entries: list[Entry] = []
    by_id: dict[str, Entry] = {}
    hard: list[tuple[Entry, str]] = []
    stack = [(f, "") for f in reversed(root.findall("file"))]
    while stack:
        node, prefix = stack.pop()
        node_name = node.find("name")
        if node_name is None or node_name.text is None:
            raise malformed("xar file without a name")
        text = node_name.text
        if node_name.get("enctype") == "base64":
            import base64

            text = base64.b64decode(text).decode("utf-8", "replace")
        path = f"{prefix}{text}"
        e = _entry(node, path, buf, heap, opts)
        entries.append(e)
        if node.get("id"):
            by_id[node.get("id")] = e
        link = node.find("type")
        if link is not None and link.text == "hardlink" and link.get("link") not in (None, "original"):
            hard.append((e, link.get("link")))
        stack += [(f, f"{path}/") for f in reversed(node.findall("file"))]
        if len(entries) > opts.limits.max_entries:
            raise ArchiveError("limitExceeded", "xar entry count")
    follow = {id(e): to for e, to in hard}
    for e, to in hard:
        seen = set()
        while to in by_id and to not in seen:
            seen.add(to)
            target = by_id[to]
            if target.kind == "file":
                e.extra["linkPath"] = target.raw_name.decode()
                e.size, e.packed, e.read, e.method = target.size, target.packed, target.read, target.method
                break
            to = follow.get(id(target), "")
    return Archive("xar", entries)


def _entry(node, path: str, buf, heap: int, opts: Options) -> Entry:
    kind = node.findtext("type", "file")
    kind = kind if kind in ("file", "directory", "symlink", "hardlink") else "other"
    if kind == "hardlink" and node.find("type").get("link") == "original":
        kind = "file"
    data = node.find("data")
    extra = {"fileID": node.get("id") or ""}
    for k in ("uid", "gid", "user", "group"):
        if node.findtext(k):
            extra[k] = node.findtext(k)
    if kind == "symlink" and node.findtext("link"):
        extra["linkPath"] = node.findtext("link")
    mtime = None
    if when := node.findtext("mtime"):
        try:
            mtime = int(datetime.fromisoformat(when.replace("Z", "+00:00")).timestamp()) * MICRO
        except ValueError:
            mtime = None
    mode = int(node.findtext("mode", "0"), 8) & 0o7777 if node.findtext("mode") else None
    e = Entry(path.encode(), kind, None if kind == "hardlink" else 0, 0, mtime, mode, declared="utf-8", method="xar (stored)", extra=extra, read=lambda: b"")
    if data is None:
        return e
    style = data.find("encoding").get("style", "") if data.find("encoding") is not None else "application/octet-stream"
    size, packed, offset = (int(data.findtext(k, "0")) for k in ("size", "length", "offset"))
    shown = {"application/octet-stream": "stored", "application/x-gzip": "gzip", "application/x-bzip2": "bzip2", "application/x-xz": "xz", "application/x-lzma": "lzma"}.get(style, style)
    e.size, e.packed, e.method = size, packed, f"xar ({shown})"
    extra["encoding"] = style
    want = data.find("extracted-checksum")
    if want is not None and want.text:
        extra |= {"extractedChecksum": want.text.strip(), "extractedChecksumStyle": want.get("style", "sha1")}

    def read() -> bytes:
        raw = take(buf, heap + offset, packed)
        if shown == "stored":
            out = raw
        elif shown == "gzip":
            try:
                out = zlib.decompress(raw, 47)
            except zlib.error as err:
                raise malformed(f"xar: {err}") from None
        elif shown in ("bzip2", "xz", "lzma"):
            out = {"bzip2": bunzip2, "xz": unxz, "lzma": lambda d, n: unxz(d, n) if d[:6] == b"\xfd7zXZ\0" else unlzma(d, n)}[shown](raw, size)
        else:
            raise ArchiveError("unsupportedMethod", style)
        if len(out) != size:
            raise ArchiveError("truncated") if len(out) < size else malformed("more output than declared")
        if want is not None and want.text:
            algo = (want.get("style") or "sha1").replace("-", "").lower()
            if algo in hashlib.algorithms_available and hashlib.new(algo, out).hexdigest() != want.text.strip().lower():
                raise ArchiveError("checksumMismatch", "xar data")
        return out

    e.read = read
    return e
