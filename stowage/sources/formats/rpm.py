"""RPM packages: the cpio payload, with what the header knows about each file."""

from __future__ import annotations

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..fields import be, take
from . import single, unix

#: Header tags by name.
TAGS = {"name": 1000, "version": 1001, "release": 1002, "arch": 1022, "digests": 1035, "basenames": 1117, "dirnames": 1118, "dirindexes": 1116, "format": 1124, "compressor": 1125, "digestalgo": 5011}


def header(buf, at: int) -> tuple[dict[int, object], int]:
    h = take(buf, at, 16)
    if h[:3] != b"\x8e\xad\xe8":
        raise malformed("RPM header")
    n, size = be(h, 8, 4), be(h, 12, 4)
    if n > 65536 or size > 256 << 20:
        raise ArchiveError("limitExceeded", "RPM header")
    index, store = take(buf, at + 16, 16 * n), take(buf, at + 16 + 16 * n, size)
    out: dict[int, object] = {}
    for i in range(n):
        tag, kind, start, count = (be(index, 16 * i + 4 * k, 4) for k in range(4))
        if kind == 6:
            out[tag] = store[start : store.index(b"\0", start)]
        elif kind in (8, 9):
            out[tag] = store[start:].split(b"\0", count)[:count]
        elif kind in (2, 3, 4, 5):
            width = 1 << kind - 2
            out[tag] = [be(store, start + width * k, width) for k in range(count)]
        else:
            out[tag] = store[start : start + count]
    return out, at + 16 + 16 * n + size


def parse(buf, name: str | None, opts: Options) -> Archive:
    take(buf, 0, 96)
    _, end = header(buf, 96)
    tags, end = header(buf, -(-end // 8) * 8)
    text = lambda k: tags[TAGS[k]].decode("utf-8", "replace") if isinstance(tags.get(TAGS[k]), bytes) else None
    body = memoryview(buf)[end:]
    magic = bytes(body[:6])
    # what the payload begins with beats what the header says
    kind = next((f for m, f in ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"]\0\0", "lzma")) if magic.startswith(m)), None)
    common = {f"rpm{k.capitalize()}": v for k in ("name", "version", "release", "arch") if (v := text(k))}
    data = single.unpack(body, kind, opts) if kind else bytes(body)
    try:
        inside = unix.parse_cpio(data, name, opts)
    except ArchiveError:
        if data[:6] in (b"070701", b"070702", b"070707"):
            raise
        shown = f"{common.get('rpmName', 'payload')}.payload"
        e = Entry(shown.encode(), "file", len(data), len(body), method=f"rpm payload ({kind or 'stored'})", declared="utf-8", extra=common, read=lambda: data)
        return Archive("rpm", [e])
    paths = {}
    bases, dirs, which = (tags.get(TAGS[k], []) for k in ("basenames", "dirnames", "dirindexes"))
    digests, algo = tags.get(TAGS["digests"], []), (tags.get(TAGS["digestalgo"]) or [1])[0]
    for i, (b, d) in enumerate(zip(bases, which)):
        if d < len(dirs):
            paths[(dirs[d] + b).lstrip(b"/")] = i
    for e in inside.entries:
        e.extra |= common
        i = paths.get(e.raw_name.removeprefix(b"./").lstrip(b"/"))
        if i is not None:
            e.extra["rpmFileIndex"] = str(i)
            if i < len(digests) and digests[i]:
                e.extra |= {"rpmFileDigest": digests[i].decode(), "rpmFileDigestAlgorithm": str(algo)}
    return Archive("rpm", inside.entries)
