"""7z: packed headers, solid folders, coder graphs."""

from __future__ import annotations

import lzma
import zlib

from ...model import Archive, ArchiveError, Entry, Options, malformed
from ..codecs import bunzip2, inflate, lzma_properties, raw_lzma, unzstd
from ..codecs.crypto import aes_cbc, seven_zip_key
from ..fields import Walk, filetime, le, take

#: Coder ids and their names.
CODERS = {b"\0": "Copy", b"\3": "Delta", b"\4": "BCJ", b"\5": "PPC", b"\6": "IA64", b"\7": "ARM", b"\x08": "ARMT", b"\x09": "SPARC", b"\x0a": "ARM64", b"\x0b": "RISCV", b"\x21": "LZMA2", b"\3\1\1": "LZMA", b"\3\3\1\3": "BCJ", b"\3\3\1\x1b": "BCJ2", b"\3\3\2\5": "PPC", b"\3\3\4\1": "IA64", b"\3\3\5\1": "ARM", b"\3\3\7\1": "ARMT", b"\3\3\x08\5": "SPARC", b"\3\4\1": "PPMD", b"\4\1\x08": "Deflate", b"\4\1\x09": "Deflate64", b"\4\2\2": "BZip2", b"\4\xf7\x11\1": "ZSTD", b"\4\xf7\x11\2": "BROTLI", b"\4\xf7\x11\4": "LZ4", b"\6\xf1\7\1": "7zAES", b"\2\3\2": "Swap2", b"\2\3\4": "Swap4"}
_BRANCH = {"BCJ": lzma.FILTER_X86, "PPC": lzma.FILTER_POWERPC, "IA64": lzma.FILTER_IA64, "ARM": lzma.FILTER_ARM, "ARMT": lzma.FILTER_ARMTHUMB, "SPARC": lzma.FILTER_SPARC}


def number(w: Walk) -> int:
    """A 7z integer: leading ones of the first byte count the bytes that follow."""
    first = w.int(1)
    extra = 0
    while extra < 8 and first & 0x80 >> extra:
        extra += 1
    low = w.int(extra)
    return low | (first & (0x7F >> extra if extra < 7 else 0)) << 8 * extra


def _bits(w: Walk, n: int) -> list[bool]:
    data = w.bytes(-(-n // 8))
    return [bool(data[i >> 3] & 0x80 >> (i & 7)) for i in range(n)]


def _maybe_all(w: Walk, n: int) -> list[bool]:
    return [True] * n if w.int(1) else _bits(w, n)


def _digests(w: Walk, n: int) -> list[int | None]:
    return [w.int(4) if there else None for there in _maybe_all(w, n)]


class Folder:
    def __init__(self, w: Walk):
        self.coders: list[tuple[bytes, int, int, bytes]] = []
        n = number(w)
        if not 0 < n <= 32:
            raise malformed("7z coder count")
        for _ in range(n):
            flag = w.int(1)
            ident = w.bytes(flag & 15)
            ins, outs = (number(w), number(w)) if flag & 16 else (1, 1)
            if ins > 32 or outs != 1:
                raise ArchiveError("unsupportedMethod", "7z coder with several outputs")
            self.coders.append((ident, ins, outs, w.bytes(number(w)) if flag & 32 else b""))
        total_in = sum(c[1] for c in self.coders)
        self.binds = [(number(w), number(w)) for _ in range(n - 1)]
        packed = total_in - len(self.binds)
        if packed < 1:
            raise malformed("7z bind pairs")
        if packed == 1:
            bound = {i for i, _ in self.binds}
            self.packed = [i for i in range(total_in) if i not in bound][:1]
        else:
            self.packed = [number(w) for _ in range(packed)]
        self.sizes: list[int] = []
        self.crc: int | None = None

    def main(self) -> int:
        bound = {o for _, o in self.binds}
        return next(i for i in range(len(self.coders)) if i not in bound)

    def size(self) -> int:
        return self.sizes[self.main()]

    def names(self) -> list[str]:
        return [CODERS.get(c[0], c[0].hex()) for c in self.coders]


def _streams(w: Walk) -> tuple[int, list[int], list[Folder], list[list[tuple[int, int | None]]]]:
    """Pack position, pack sizes, folders, and the (size, crc) of each folder's files."""
    at, sizes, folders, subs = 0, [], [], None
    while (kind := number(w)) != 0:
        if kind == 6:
            at, n = number(w), number(w)
            while (k := number(w)) != 0:
                if k == 9:
                    sizes = [number(w) for _ in range(n)]
                elif k == 10:
                    _digests(w, n)
                else:
                    raise malformed("7z pack info")
        elif kind == 7:
            if number(w) != 11:
                raise malformed("7z folders")
            n = number(w)
            if n > 1_000_000:
                raise ArchiveError("limitExceeded", "7z folder count")
            if w.int(1):
                raise ArchiveError("unsupportedMethod", "7z external folders")
            folders = [Folder(w) for _ in range(n)]
            while (k := number(w)) != 0:
                if k == 12:
                    for f in folders:
                        f.sizes = [number(w) for _ in f.coders]
                elif k == 10:
                    for f, c in zip(folders, _digests(w, n)):
                        f.crc = c
                else:
                    raise malformed("7z folder info")
        elif kind == 8:
            counts = [1] * len(folders)
            k = number(w)
            if k == 13:
                counts = [number(w) for _ in folders]
                k = number(w)
            subs = []
            for f, c in zip(folders, counts):
                own = [number(w) for _ in range(c - 1)] if k == 9 and c else []
                rest = f.size() - sum(own) if c else 0
                if rest < 0:
                    raise malformed("7z stream sizes")
                subs.append([(s, None) for s in [*own, *([rest] if c else [])]])
            if k == 9:
                k = number(w)
            unknown = [(i, j) for i, (f, s) in enumerate(zip(folders, subs)) for j in range(len(s)) if not (len(s) == 1 and f.crc is not None)]
            crcs = dict.fromkeys(unknown)
            while k != 0:
                if k == 10:
                    crcs = dict(zip(unknown, _digests(w, len(unknown))))
                else:
                    w.bytes(number(w))
                k = number(w)
            subs = [[(s, f.crc if len(own) == 1 and f.crc is not None else crcs.get((i, j))) for j, (s, _) in enumerate(own)] for i, (f, own) in enumerate(zip(folders, subs))]
        else:
            raise malformed("7z streams")
    return at, sizes, folders, subs if subs is not None else [[(f.size(), f.crc)] for f in folders]


def _decode(coder: tuple[bytes, int, int, bytes], ins: list[bytes], size: int, opts: Options) -> bytes:
    ident, _, _, props = coder
    name = CODERS.get(ident)
    data = ins[0]
    if name == "Copy":
        return data[:size]
    if name == "LZMA":
        return raw_lzma(data, [lzma_properties(props)], size)
    if name == "LZMA2":
        d = props[0] if props else 40
        if d > 40:
            raise malformed("LZMA2 properties")
        width = 0xFFFFFFFF if d == 40 else (2 | d & 1) << d // 2 + 11
        if width > opts.limits.max_dictionary:
            raise ArchiveError("limitExceeded", "dictionary")
        return raw_lzma(data, [{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, width)}], size)
    if name == "Deflate":
        return inflate(data)[:size]
    if name == "Deflate64":
        from ..codecs.deflate64 import inflate64

        return inflate64(data)[:size]
    if name == "BZip2":
        return bunzip2(data)[:size]
    if name == "ZSTD":
        return unzstd(data)[:size]
    if name == "PPMD":
        from ..codecs.ppmd import ppmd7

        if len(props) != 5:
            raise malformed("PPMd properties")
        if le(props, 1, 4) > opts.limits.max_dictionary:
            raise ArchiveError("limitExceeded", "PPMd memory")
        return ppmd7(data, props[0], le(props, 1, 4), size)
    if name == "Delta":
        from ..codecs.branch import delta

        return delta(data, (props[0] if props else 0) + 1)
    if name in _BRANCH:
        from ..codecs.xz import branch

        return branch(data, _BRANCH[name], le(props, 0, 4) if len(props) >= 4 else 0)
    if name == "ARM64":
        from ..codecs.branch import arm64

        return arm64(data, le(props, 0, 4) if len(props) >= 4 else 0)
    if name == "RISCV":
        from ..codecs.branch import riscv

        return riscv(data, le(props, 0, 4) if len(props) >= 4 else 0)
    if name in ("Swap2", "Swap4"):
        from ..codecs.branch import swap

        return swap(data, int(name[-1]))
    if name == "BCJ2":
        from ..codecs.branch import bcj2

        return bcj2(*ins[:4], size)
    if name == "7zAES":
        if opts.password is None:
            raise ArchiveError("passwordRequired")
        if len(props) < 2:
            raise malformed("7zAES properties")
        salt_n, iv_n = (props[0] >> 7 & 1) + (props[1] >> 4), (props[0] >> 6 & 1) + (props[1] & 15)
        key = seven_zip_key(opts.password, props[2 : 2 + salt_n], props[0] & 63, opts.limits.max_kdf_power)
        return aes_cbc(key, props[2 + salt_n : 2 + salt_n + iv_n].ljust(16, b"\0"), data)[:size]
    raise ArchiveError("unsupportedMethod", name or f"7z coder {ident.hex()}")


def unpack(folder: Folder, packed: list[bytes], opts: Options) -> bytes:
    """A folder's output, by following its graph from the last coder back."""
    first = []
    n = 0
    for c in folder.coders:
        first.append(n)
        n += c[1]
    source = dict(folder.binds)

    def made(i: int) -> bytes:
        ins = []
        for k in range(folder.coders[i][1]):
            at = first[i] + k
            if at in source:
                ins.append(made(source[at]))
            elif at in folder.packed:
                ins.append(packed[folder.packed.index(at)])
            else:
                raise malformed("7z unbound stream")
        return _decode(folder.coders[i], ins, folder.sizes[i], opts)

    encrypted = "7zAES" in folder.names()
    try:
        out = made(folder.main())
    except ArchiveError as e:
        if encrypted and e.code in ("malformed", "truncated"):
            raise ArchiveError("wrongPassword") from None
        raise
    if len(out) < folder.size():
        raise ArchiveError("truncated")
    if folder.crc is not None and zlib.crc32(out) != folder.crc:
        raise ArchiveError("wrongPassword") if encrypted else ArchiveError("checksumMismatch", "7z folder")
    return out


def _packed(buf, base: int, sizes: list[int]) -> list[bytes]:
    out = []
    for s in sizes:
        out.append(take(buf, base, s))
        base += s
    return out


def parse(buf, name: str | None, opts: Options) -> Archive:
    h = take(buf, 0, 32)
    if zlib.crc32(h[12:32]) != le(h, 8, 4):
        raise malformed("7z start header checksum")
    where, size, crc = le(h, 12, 8), le(h, 20, 8), le(h, 28, 4)
    if size > opts.limits.max_total_metadata:
        raise ArchiveError("limitExceeded", "7z header")
    if not size:
        return Archive("7z", [])
    raw = take(buf, 32 + where, size)
    if zlib.crc32(raw) != crc:
        raise malformed("7z header checksum")
    w = Walk(raw, what="7z header")
    for _ in range(8):
        kind = number(w)
        if kind != 0x17:
            break
        at, sizes, folders, _ = _streams(w)
        if len(folders) != 1:
            raise malformed("7z packed header")
        w = Walk(unpack(folders[0], _packed(buf, 32 + at, sizes), opts), what="7z header")
    if kind != 1:
        raise malformed("7z header")
    at, sizes, folders, subs = 0, [], [], []
    kind = number(w)
    if kind == 2:
        while (k := number(w)) != 0:
            w.bytes(number(w))
        kind = number(w)
    if kind == 3:
        _streams(w)
        kind = number(w)
    if kind == 4:
        at, sizes, folders, subs = _streams(w)
        kind = number(w)
    files: list[dict] = []
    if kind == 5:
        n = number(w)
        if n > opts.limits.max_entries:
            raise ArchiveError("limitExceeded", "7z entry count")
        files = [{"name": b"", "stream": True} for _ in range(n)]
        _properties(w, files)
    return Archive("7z", _entries(buf, files, 32 + at, sizes, folders, subs, opts))


def _properties(w: Walk, files: list[dict]) -> None:
    empty: list[dict] = []
    while (k := number(w)) != 0:
        size = number(w)
        own = Walk(w.bytes(size), what="7z property")
        if k == 14:
            for f, e in zip(files, _bits(own, len(files))):
                f["stream"] = not e
            empty = [f for f in files if not f["stream"]]
        elif k in (15, 16):
            for f, e in zip(empty, _bits(own, len(empty))):
                f["emptyFile" if k == 15 else "anti"] = e
        elif k == 17:
            if own.int(1):
                raise ArchiveError("unsupportedMethod", "7z external names")
            rest, at = own.data, own.at
            for f in files:
                end = at
                while rest[end : end + 2] != b"\0\0":
                    end += 2
                    if end >= len(rest):
                        raise malformed("7z names")
                f["name"], at = rest[at:end], end + 2
        elif k in (18, 19, 20, 21, 24):
            there = _maybe_all(own, len(files))
            if own.int(1):
                raise ArchiveError("unsupportedMethod", "7z external property")
            for f, t in zip(files, there):
                if t:
                    f[k] = own.int(4 if k == 21 else 8)


def _entries(buf, files: list[dict], base: int, sizes: list[int], folders: list[Folder], subs, opts: Options) -> list[Entry]:
    starts, at, use = [], base, 0
    for f in folders:
        n = len(f.packed)
        starts.append((at, sizes[use : use + n]))
        at += sum(sizes[use : use + n])
        use += n
    held: dict[int, bytes] = {}

    def folder(i: int) -> bytes:
        if i not in held:
            held.clear()
            held[i] = unpack(folders[i], _packed(buf, *starts[i]), opts)
        return held[i]

    slots = [(i, j) for i, s in enumerate(subs) for j in range(len(s))]
    offsets = {}
    for i, s in enumerate(subs):
        total = 0
        for j, (n, _) in enumerate(s):
            offsets[i, j] = total
            total += n
    out, use = [], 0
    for f in files:
        attr = f.get(21)
        unix = attr >> 16 if attr is not None and attr & 0x8000 else 0
        anti, folderish = bool(f.get("anti")), not f["stream"] and not f.get("emptyFile") and not f.get("anti")
        kind = "symlink" if unix & 0o170000 == 0o120000 or attr is not None and attr & 0x400 and not unix else "directory" if folderish or attr is not None and attr & 16 and not f["stream"] and not f.get("emptyFile") else "other" if anti else "file"
        shown = f["name"].decode("utf-16-le", "replace")
        extra = {}
        if anti:
            extra["anti"] = "true"
        if not f["stream"]:
            extra["emptyStream"] = "true"
            if f.get("emptyFile"):
                extra["emptyFile"] = "true"
        if attr is not None:
            extra["windowsAttributes"] = f"0x{attr:08x}"
        for k, label in ((18, "creationTime"), (19, "accessTime"), (24, "startPosition")):
            if k in f:
                extra[label] = str(f[k])
        e = Entry(shown.encode("utf-8", "replace"), kind, 0, 0 if not f["stream"] else None, filetime(f[20]) if 20 in f else None, unix & 0o7777 if unix else None, declared="utf-8", extra=extra, method="", read=lambda: b"")
        if f["stream"]:
            if use >= len(slots):
                raise malformed("7z file without a stream")
            i, j = slots[use]
            use += 1
            size, crc = subs[i][j]
            labels = folders[i].names()
            e.size, e.crc, e.method = size, crc, "+".join(labels)
            e.solid = i if len(subs[i]) > 1 else -1
            e.packed = sum(starts[i][1]) if len(subs[i]) == 1 else None
            e.encrypted = "7zAES" in labels
            extra["encryption"] = "7zAES" if e.encrypted else "none"

            def read(i=i, start=offsets[i, j], size=size, crc=crc, locked=e.encrypted) -> bytes:
                data = folder(i)[start : start + size]
                if len(data) < size:
                    raise ArchiveError("truncated")
                if crc is not None and zlib.crc32(data) != crc:
                    raise ArchiveError("wrongPassword") if locked else ArchiveError("checksumMismatch", "CRC-32")
                return data

            e.read = read
        out.append(e)
    return out
