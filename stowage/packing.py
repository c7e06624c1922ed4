"""Scaffolding: table rows packed into archives with standard writers, for queries and tests that have no archives to read."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of streams that a worker gathers before it passes them on.
HELD = 1 << 22

#: (name, kind, data or link target) of the entries of one archive.
Items = list[tuple[str, str, bytes]]


def pack_zip(items: Items) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, kind, data) in enumerate(items):
            info = zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6))
            info.external_attr = (0o120777 if kind == "symlink" else 0o40755 if kind == "directory" else 0o100644) << 16
            info.compress_type = (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[i % 4]
            z.writestr(info, data)
    return out.getvalue()


def pack_tar(items: Items) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, kind, data in items:
            info = tarfile.TarInfo(name)
            info.mtime = 1577934246
            if kind == "file":
                info.size = len(data)
            else:
                info.type = {"hardlink": tarfile.LNKTYPE, "symlink": tarfile.SYMTYPE, "directory": tarfile.DIRTYPE}[kind]
                info.linkname = data.decode() if kind != "directory" else ""
            t.addfile(info, io.BytesIO(data) if kind == "file" else None)
    return out.getvalue()


def pack_cpio(items: Items, inode=lambda name, i: (i + 1, 1)) -> bytes:
    out = bytearray()
    for i, (name, kind, data) in enumerate([*items, ("TRAILER!!!", "trailer", b"")]):
        ino, nlink = inode(name, i) if kind != "trailer" else (0, 1)
        mode = {"file": 0o100644, "symlink": 0o120777, "directory": 0o40755, "trailer": 0}[kind]
        raw = name.encode() + b"\0"
        values = (ino, mode, 0, 0, nlink, 1577934246, len(data), 0, 1, 0, 0, len(raw), 0)
        out += b"070701" + b"".join(b"%08X" % v for v in values) + raw
        out += b"\0" * (-len(out) % 4) + data
        out += b"\0" * (-len(out) % 4)
    return bytes(out)


def pack_ar(items: Items) -> bytes:
    out = bytearray(b"!<arch>\n")
    for name, _, data in items:
        raw = name.encode()
        out += b"%-16s%-12d%-6d%-6d%-8s%-10d`\n" % (b"#1/%d" % len(raw), 1577934246, 0, 0, b"100644", len(raw) + len(data))
        out += raw + data
        out += b"\n" * (len(out) % 2)
    return bytes(out)


def _seven_number(v: int) -> bytes:
    """A 7z number: leading ones of the first byte count the bytes that follow."""
    for n in range(8):
        if v < 1 << 7 * (n + 1):
            return bytes([(0xFF00 >> n) & 255 | v >> 8 * n]) + (v & (1 << 8 * n) - 1).to_bytes(n, "little")
    return b"\xff" + v.to_bytes(8, "little")


def _seven_bits(flags: list[bool]) -> bytes:
    return bytes(sum(1 << 7 - j for j, f in enumerate(flags[i : i + 8]) if f) for i in range(0, len(flags), 8))


#: Coder ids of 7z, with their properties, and the encoders.
SEVEN = {
    "copy": (b"\0", b"", lambda b: b),
    "lzma": (b"\3\1\1", b"\x5d" + (1 << 20).to_bytes(4, "little"), lambda b: lzma.compress(b, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}])),
    "lzma2": (b"\x21", b"\x10", lambda b: lzma.compress(b, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])),
    "deflate": (b"\4\1\x08", b"", lambda b: zlib.compress(b, wbits=-15)),
    "bzip2": (b"\4\2\2", b"", bz2.compress),
}


def pack_7z(items: Items, coder: str = "lzma2") -> bytes:
    """One solid folder; files without bytes have no stream."""
    num, own, props, encode = _seven_number, *SEVEN[coder]
    full = [d for _, _, d in items if d]
    whole = b"".join(full)
    packed = encode(whole) if full else b""
    head = b"\1"
    if full:
        head += b"\4\6" + num(0) + num(1) + b"\x09" + num(len(packed)) + b"\0"
        head += b"\7\x0b" + num(1) + b"\0" + num(1) + bytes([len(own) | (0x20 if props else 0)]) + own + (num(len(props)) + props if props else b"") + b"\x0c" + num(len(whole)) + b"\0"
        head += b"\x08\x0d" + num(len(full)) + (b"\x09" + b"".join(num(len(d)) for d in full[:-1]) if len(full) > 1 else b"") + b"\x0a\1" + b"".join(zlib.crc32(d).to_bytes(4, "little") for d in full) + b"\0\0"
    names = b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _, _ in items)
    head += b"\5" + num(len(items))
    if len(full) < len(items):
        bare = _seven_bits([not d for _, _, d in items])
        files = _seven_bits([k != "directory" for _, k, d in items if not d])
        head += b"\x0e" + num(len(bare)) + bare + b"\x0f" + num(len(files)) + files
    head += b"\x11" + num(len(names)) + names + b"\0\0"
    start = len(packed).to_bytes(8, "little") + len(head).to_bytes(8, "little") + zlib.crc32(head).to_bytes(4, "little")
    return b"7z\xbc\xaf\x27\x1c\0\4" + zlib.crc32(start).to_bytes(4, "little") + start + packed + head


def pack_rpm(items: Items) -> bytes:
    """A lead, two empty headers and a compressed cpio."""
    lead = b"\xed\xab\xee\xdb\3\0\0\0\0\1" + b"packed".ljust(66, b"\0") + b"\0\1\0\5" + bytes(16)
    header = b"\x8e\xad\xe8\1" + bytes(12)
    return lead + header + header + gzip.compress(pack_cpio(items), mtime=0)


def pack_lha(items: Items) -> bytes:
    """Stored entries with level 2 headers."""
    from .functions.sql import crc16

    out = bytearray()
    for name, _, data in items:
        folder, _, base = name.rpartition("/")
        parts = [(1, base.encode())] + ([(2, folder.replace("/", "\xff").encode("latin-1") + b"\xff")] if folder else [])
        extra = b"".join(bytes([tag]) + raw + b"SS" for tag, raw in parts)
        sizes = [len(raw) + 3 for _, raw in parts] + [0]
        extra = b"".join(bytes([tag]) + raw + n.to_bytes(2, "little") for (tag, raw), n in zip(parts, sizes[1:]))
        size = 26 + len(extra)
        pad = b"\0" if size % 256 == 0 else b""
        body = b"-lh0-" + struct.pack("<IIIBBHBH", len(data), len(data), 1577934246, 0x20, 2, crc16(data), ord("U"), sizes[0]) + extra + pad
        out += (size + len(pad)).to_bytes(2, "little") + body + data
    return bytes(out) + b"\0"


def pack_arj(items: Items) -> bytes:
    """Stored entries."""

    def block(head: bytes) -> bytes:
        return b"\x60\xea" + len(head).to_bytes(2, "little") + head + zlib.crc32(head).to_bytes(4, "little") + b"\0\0"

    out = block(struct.pack("<BBBBBBBBIIIIHHH", 30, 11, 1, 2, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0) + b"packed.arj\0\0")
    for name, _, data in items:
        out += block(struct.pack("<BBBBBBBBIIIIHHH", 30, 11, 1, 2, 0x10, 0, 0, 0, 0x50210000, len(data), len(data), zlib.crc32(data), 0, 0o100644, 0) + name.encode() + b"\0\0") + data
    return out + b"\x60\xea\0\0"


def pack_rar(items: Items) -> bytes:
    """RAR 5 with stored entries."""

    def vint(v: int) -> bytes:
        n = max(1, -(-v.bit_length() // 7))
        return bytes((v >> 7 * i & 127) | (128 if i < n - 1 else 0) for i in range(n))

    def block(*fields: int | bytes) -> bytes:
        head = b"".join(vint(f) if isinstance(f, int) else f for f in fields)
        whole = vint(len(head)) + head
        return zlib.crc32(whole).to_bytes(4, "little") + whole

    out = b"Rar!\x1a\7\1\0" + block(1, 0, 0)
    for name, _, data in items:
        raw = name.encode()
        out += block(2, 2, len(data), 4, len(data), 0o100644, zlib.crc32(data).to_bytes(4, "little"), 0, 1, len(raw), raw) + data
    return out + block(5, 0, 0)


PACKERS = {
    "zip": pack_zip,
    "tar": pack_tar,
    "tar.gz": lambda items: gzip.compress(pack_tar(items), mtime=0),
    "tar.xz": lambda items: lzma.compress(pack_tar(items), preset=0),
    "tar.bz2": lambda items: bz2.compress(pack_tar(items), 1),
    "tar.zst": lambda items: compress("zst", pack_tar(items)),
    "cpio": pack_cpio,
    "cpio.gz": lambda items: gzip.compress(pack_cpio(items), mtime=0),
    "ar": pack_ar,
    "7z": pack_7z,
    "lzma.7z": lambda items: pack_7z(items, "lzma"),
    "rpm": pack_rpm,
    "lzh": pack_lha,
    "arj": pack_arj,
    "rar": pack_rar,
}


def _dictionary(data: bytes) -> int:
    """The least power of two that holds the data: a larger dictionary finds no more, but is cleared for each stream. At most the library's default."""
    return min(1 << 23, max(4096, 1 << (len(data) - 1).bit_length()))


@lru_cache(maxsize=1)
def _lzma1(data: bytes) -> bytes:
    """The body that .lzma and .lz have in common."""
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "preset": lzma.PRESET_DEFAULT, "dict_size": _dictionary(data)}])


@lru_cache(maxsize=1)
def _xz(data: bytes) -> bytes:
    """A whole .xz, also the one chunk of a short .pbzx."""
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": _dictionary(data)}])


def lzip(data: bytes) -> bytes:
    head = b"LZIP\1" + bytes([_dictionary(data).bit_length() - 1]) + _lzma1(data)
    return head + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(8, "little") + (len(head) + 20).to_bytes(8, "little")


def pbzx(data: bytes) -> bytes:
    out = b"pbzx" + (1 << 24).to_bytes(8, "big")
    for i in range(0, len(data), 4096):
        p = data[i : i + 4096]
        x = _xz(p)
        out += len(p).to_bytes(8, "big") + len(x).to_bytes(8, "big") + x
    return out


def compress(kind: str, data: bytes) -> bytes:
    """A single-file stream by its suffix."""
    if kind == "gz":
        return gzip.compress(data, mtime=0)
    if kind == "bz2":
        return bz2.compress(data)
    if kind == "xz":
        return _xz(data)
    if kind == "lzma":
        return b"\x5d" + _dictionary(data).to_bytes(4, "little") + b"\xff" * 8 + _lzma1(data)
    if kind == "zst":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if kind == "lz":
        return lzip(data)
    if kind == "pbzx":
        return pbzx(data)
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, {"lz4": "lz4", "br": "brotli"}[kind]) as s:
        s.write(data)
    return out.getvalue().to_pybytes()


def _items(g: pd.DataFrame) -> Items:
    g = g.sort_values("o")
    return [(n, k, bytes(d) if d is not None else b"") for n, k, d in zip(g["n"], g["k"], g["d"])]


def archives_of(rows: DataFrame, path: Column, order: str, name: Column, data: Column, kind: str, entry_kind: Column | None = None, packer=None) -> DataFrame:
    """(path, content): rows with equal path packed in order into one archive. Paths should hold few rows."""
    make = packer or PACKERS[kind]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [g["path"].iloc[0]], "content": [make(_items(g))]})

    picked = rows.select(path.alias("path"), F.col(order).alias("o"), name.alias("n"), (entry_kind if entry_kind is not None else F.lit("file")).alias("k"), data.cast("binary").alias("d"))
    return picked.groupBy("path").applyInPandas(run, "path string, content binary")


def streams_of(rows: DataFrame, path: Column, data: Column, kind: str) -> DataFrame:
    """(path, content): each row as one compressed stream."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([compress(kind, bytes(b) if b is not None else b"") for b in s], dtype=object)

    return rows.select(path.alias("path"), run(data.cast("binary")).alias("content"))


def archives_as(rows: DataFrame, path: Column, order: str, name: Column, data: Column, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, path, content): rows with equal path packed in order into an archive of every kind, the kind behind its path. Rows are dealt out once."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        items = _items(g)
        return pd.DataFrame([(kind, f"{g['path'].iloc[0]}.{kind}", PACKERS[kind](items)) for kind in kinds], columns=["kind", "path", "content"])

    picked = rows.select(path.alias("path"), F.col(order).alias("o"), name.alias("n"), F.lit("file").alias("k"), data.cast("binary").alias("d"))
    return picked.groupBy("path").applyInPandas(run, "kind string, path string, content binary")


def streams_as(rows: DataFrame, path: Column, data: Column, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, path, content): each row as a compressed stream of every kind, the kind behind its path. Rows are read once."""
    fields = pa.schema([("kind", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        out, size = [], 0
        for b in batches:
            for path, data in zip(*b.columns):
                raw = data.as_py() or b""
                out += [(kind, f"{path.as_py()}.{kind}", compress(kind, raw)) for kind in kinds]
                size += sum(len(x) for _, _, x in out[-len(kinds) :])
                if size >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields)], schema=fields)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields)], schema=fields)

    return rows.select(path.alias("path"), data.cast("binary").alias("data")).mapInArrow(run, "kind string, path string, content binary")
