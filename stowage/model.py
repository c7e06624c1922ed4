"""Rows, errors and options of the archive engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

MICRO = 1_000_000


class ArchiveError(Exception):
    """An outcome that belongs in a row. Codes: unsupportedFormat unsupportedMethod malformed truncated
    passwordRequired wrongPassword checksumMismatch limitExceeded io notFound."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


def malformed(detail: str) -> ArchiveError:
    return ArchiveError("malformed", detail)


@dataclass
class Limits:
    """What decides which rows fail. The defaults."""

    max_entry_size: int = 4 << 30
    max_total_size: int = 64 << 30
    max_in_memory: int = 1 << 30
    max_entries: int = 1_000_000
    max_metadata: int = 16 << 20
    max_total_metadata: int = 256 << 20
    max_records: int = 65_536
    max_components: int = 1_024
    max_dictionary: int = 1 << 30
    max_volumes: int = 128
    max_kdf_power: int = 24


@dataclass
class Options:
    encoding: str = "auto"  # auto, utf8Only or a charset
    language: str | None = "ja"
    password: str | None = None
    recover: bool = False
    apple_double: str = "merge"  # merge, hide or expose
    scan_sfx: bool = True
    max_sfx_scan: int = 1 << 20
    timezone: str = "UTC"
    volume_starts: tuple[int, ...] = ()  # where the volumes of a joined set begin
    limits: Limits = field(default_factory=Limits)

    @classmethod
    def of(cls, given: dict[str, str]) -> Options:
        """From the string options of a data source; names in any case, limits by name."""
        low = {k.lower().replace("_", ""): v for k, v in given.items()}
        out = cls()
        for holder in (out, out.limits):
            for f in fields(holder):
                if (v := low.get(f.name.replace("_", ""))) is not None and f.name not in ("limits", "volume_starts"):
                    now = getattr(holder, f.name)
                    setattr(holder, f.name, v.lower() == "true" if isinstance(now, bool) else int(v) if isinstance(now, int) else v)
        return out


@dataclass
class Entry:
    """A row of an archive; `read` gives the verified payload."""

    raw_name: bytes
    kind: str = "file"
    size: int | None = None
    packed: int | None = None
    mtime: int | None = None  # microseconds since 1970, UTC
    mode: int | None = None
    encrypted: bool = False
    incomplete: bool = False
    solid: int = -1
    crc: int | None = None
    method: str = ""
    declared: str | None = None
    dir_hint: bool = False
    extra: dict[str, str] = field(default_factory=dict)
    name: str | None = None
    links: dict[str, bytes] = field(default_factory=dict)  # extra keys whose values are still undecoded
    read: Callable[[], bytes] | None = None
    stream: Callable[[], Iterator[bytes]] | None = None  # the same in pieces, for entries larger than memory; fails at its end
    record: tuple[int, int, int, int] | None = None  # record start, end, payload start, end
    index: int = -1


@dataclass
class Archive:
    format: str
    entries: list[Entry]
    name_encoding: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())])

RECORD = T.StructType([T.StructField(n, T.LongType()) for n in ("record_start", "record_end", "payload_start", "payload_end")])

ENTRY_FIELDS = [
    T.StructField("archive_path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("raw_name", T.BinaryType()),
    T.StructField("declared_encoding", T.StringType()),
    T.StructField("is_directory_hint", T.BooleanType()),
    T.StructField("name", T.StringType()),
    T.StructField("path_components", T.ArrayType(T.StringType())),
    T.StructField("kind", T.StringType()),
    T.StructField("uncompressed_size", T.LongType()),
    T.StructField("compressed_size", T.LongType()),
    T.StructField("modification_date", T.TimestampType()),
    T.StructField("posix_permissions", T.IntegerType()),
    T.StructField("is_encrypted", T.BooleanType()),
    T.StructField("is_incomplete", T.BooleanType()),
    T.StructField("solid_group", T.IntegerType()),
    T.StructField("crc32", T.LongType()),
    T.StructField("method_description", T.StringType()),
    T.StructField("format_specific", T.MapType(T.StringType(), T.StringType())),
    T.StructField("raw_record", RECORD),
    T.StructField("error", ERROR),
]
#: Listing rows. One row with a null index and an error stands for an archive that does not open.
ENTRIES = T.StructType(ENTRY_FIELDS)
#: Listing rows with verified payloads; a payload that fails leaves content null and an error.
CONTENTS = T.StructType([*ENTRY_FIELDS[:-1], T.StructField("bytes", T.LongType()), T.StructField("content", T.BinaryType()), ENTRY_FIELDS[-1]])
ARCHIVES = T.StructType([T.StructField("archive_path", T.StringType()), T.StructField("format", T.StringType()), T.StructField("length", T.LongType()), T.StructField("entry_count", T.IntegerType()), T.StructField("name_encoding", T.StringType()), T.StructField("volume_set", T.ArrayType(T.StringType())), T.StructField("error", ERROR)])
