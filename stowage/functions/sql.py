"""Column functions and SQL registration: detection, checksums that Spark lacks, names, table functions."""

from __future__ import annotations

import binascii
import hashlib
import hmac
import zlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ArchiveError, Options
from ..sources import detect as detection
from ..sources import names


def _code(buf, name) -> str:
    try:
        return detection.detect(buf, name)
    except ArchiveError as e:
        return f"error:{e.code}"


@F.pandas_udf(T.StringType())
def detect_format(path: pd.Series, content: pd.Series) -> pd.Series:
    """Format of each file, error:unsupportedFormat if none."""
    return pd.Series([None if b is None else _code(b, p) for p, b in zip(path, content)])


def _reflected(poly: int, bits: int) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (poly if i & 1 else 0)
        out.append(i)
    return out


_CRC16, _CRC64 = _reflected(0xA001, 16), _reflected(0xC96C5795D7870F42, 64)


def crc16(data: bytes) -> int:
    """CRC-16/ARC."""
    c = 0
    for b in data:
        c = c >> 8 ^ _CRC16[(c ^ b) & 255]
    return c


def crc64(data: bytes) -> int:
    """CRC-64 of xz (ECMA-182, reflected)."""
    c = (1 << 64) - 1
    for b in data:
        c = c >> 8 ^ _CRC64[(c ^ b) & 255]
    return c ^ (1 << 64) - 1


def xmodem(data: bytes) -> int:
    return binascii.crc_hqx(data, 0)


def blake2sp(data: bytes) -> bytes:
    """BLAKE2sp: eight interleaved BLAKE2s leaves of 64-byte blocks under one root."""
    leaf = [hashlib.blake2s(digest_size=32, fanout=8, depth=2, node_offset=i, node_depth=0, inner_size=32, last_node=i == 7) for i in range(8)]
    for at in range(0, len(data), 64):
        leaf[at // 64 % 8].update(data[at : at + 64])
    root = hashlib.blake2s(digest_size=32, fanout=8, depth=2, node_offset=0, node_depth=1, inner_size=32, last_node=True)
    for x in leaf:
        root.update(x.digest())
    return root.digest()


def cpio_sum(data: bytes) -> int:
    return sum(data) & 0xFFFFFFFF


def rar13_sum(data: bytes) -> int:
    """The rolling 16-bit checksum of the first RAR."""
    c = 0
    for b in data:
        c = c + b & 0xFFFF
        c = (c << 1 | c >> 15) & 0xFFFF
    return c


def same_digest(a: bytes, b: bytes) -> bool:
    """Comparison in constant time."""
    return hmac.compare_digest(a, b)


def _hash_udf(fn, kind):
    @F.pandas_udf(kind)
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else fn(bytes(b)) for b in content], dtype=object)

    return run


def _xxh(bits: int):
    def run(data: bytes) -> str:
        import xxhash

        return (xxhash.xxh32 if bits == 32 else xxhash.xxh64)(data).hexdigest()

    return run


def functions() -> dict:
    """Scalar functions over binary columns, by SQL name."""
    return {
        "crc16_arc": _hash_udf(crc16, T.LongType()),
        "crc16_xmodem": _hash_udf(xmodem, T.LongType()),
        "crc64_xz": _hash_udf(lambda b: f"{crc64(b):016x}", T.StringType()),
        "xxh32": _hash_udf(_xxh(32), T.StringType()),
        "xxh64": _hash_udf(_xxh(64), T.StringType()),
        "blake2s": _hash_udf(lambda b: hashlib.blake2s(b).hexdigest(), T.StringType()),
        "blake2sp": _hash_udf(lambda b: blake2sp(b).hex(), T.StringType()),
        "cpio_sum": _hash_udf(cpio_sum, T.LongType()),
        "rar13_sum": _hash_udf(rar13_sum, T.LongType()),
        "adler32": _hash_udf(lambda b: zlib.adler32(b), T.LongType()),
    }


NAME = T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])


def name_detector(options: Options | None = None):
    """Column function: (raw name) -> encoding, text, confidence."""
    opts = options or Options()

    @F.pandas_udf(NAME)
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([names.detect(bytes(b), opts.encoding, opts.language) if b is not None else (None, None, None) for b in raw], columns=["encoding", "text", "confidence"])

    return run


def archive_names(rows, group: str = "group", raw: str = "raw", options: Options | None = None):
    """(group, raw, encoding, text): names resolved with one charset for each group.

    Distinct names with their counts go to the detector, so a group's task holds names, not rows.
    """
    opts = options or Options()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        charset = names.detect_archive([bytes(b) for b in g[raw]], opts.encoding, opts.language)
        text = [names.resolve(bytes(b), None, charset, opts.encoding, opts.language) for b in g[raw]]
        return pd.DataFrame({group: g[group], raw: g[raw], "encoding": [charset or "utf-8"] * len(g), "text": text})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, raw).distinct().groupBy(group).applyInPandas(run, f"`{group}` {kind}, `{raw}` binary, encoding string, text string")


def decoder(charset: str):
    """Column function: strict decoding, null where it fails."""

    @F.pandas_udf(T.StringType())
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else names.decode(bytes(b), charset) for b in raw], dtype=object)

    return run


ENTRY_TABLE = "index int, name string, kind string, bytes long, sha256 string, error string"


@F.udtf(returnType=ENTRY_TABLE)
class ArchiveEntries:
    """SELECT ... FROM files, LATERAL archive_entries(path, content)"""

    def eval(self, path: str, content: bytes):
        from ..sources.reader import digest_rows

        for r in digest_rows(path, content or b"", Options()):
            yield r.get("index"), r.get("name"), r.get("kind"), r.get("bytes"), r.get("sha256"), (r.get("error") or {}).get("code")


def register(spark: SparkSession) -> None:
    """Makes all of this available to SQL."""
    spark.udf.register("detect_format", detect_format)
    for name, fn in functions().items():
        spark.udf.register(name, fn)
    spark.udf.register("detect_name", name_detector())
    spark.udtf.register("archive_entries", ArchiveEntries)
