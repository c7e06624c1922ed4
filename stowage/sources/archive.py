"""Relations over archives: from frames of bytes, and as the data source `archive`.

Every archive is one unit of work: its rows are produced in order by one task, and an archive, or an
entry, that fails becomes a row with an error. Nothing is shuffled here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import ARCHIVES, CONTENTS, ENTRIES, ERROR, Options
from . import reader
from .volumes import group

#: Rows and payload bytes handed back at once.
ROWS, BYTES = 2000, 8 << 20


def _batched(made: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in made:
        held.append(row)
        size += len(row.get("content") or b"")
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _mapped(files: DataFrame, make: Callable[[str | None, bytes], Iterator[dict]], schema: T.StructType, path: str, content: str) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                where, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                yield from _batched(make(where, memoryview(data) if data is not None else b""), arrow)

    return files.select(path, content).mapInArrow(run, schema)


def entries(files: DataFrame, options: Options | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """Metadata rows of archives given as (path, content), in archive order within each."""
    opts = options or Options()
    return _mapped(files, lambda p, b: reader.rows(p, b, opts), ENTRIES, path, content)


def contents(files: DataFrame, options: Options | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """Metadata rows with verified payloads."""
    opts = options or Options()
    return _mapped(files, lambda p, b: reader.rows(p, b, opts, True), CONTENTS, path, content)


DIGESTS = T.StructType([*ENTRIES.fields[:-1], T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("error", ERROR)])


def digests(files: DataFrame, options: Options | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """Metadata rows with byte counts and SHA-256, payloads never leaving the worker."""
    opts = options or Options()
    return _mapped(files, lambda p, b: reader.digest_rows(p, b, opts), DIGESTS, path, content)


CHUNKS = T.StructType([T.StructField("archive_path", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("chunk", T.BinaryType()), T.StructField("error", ERROR)])


def chunks(files: DataFrame, options: Options | None = None, size: int = 1 << 20, path: str = "path", content: str = "content") -> DataFrame:
    """Payloads in pieces of `size` bytes, after verification."""
    opts = options or Options()

    def make(p: str | None, b) -> Iterator[dict]:
        for row in reader.rows(p, b, opts, True):
            data = row.get("content")
            if data is None:
                yield {"archive_path": p, "index": row.get("index"), "seq": 0, "chunk": None, "error": row["error"]}
            for k in range(0, len(data or b""), size):
                yield {"archive_path": p, "index": row["index"], "seq": k // size, "chunk": data[k : k + size], "error": None}

    return _mapped(files, make, CHUNKS, path, content)


def archives(files: DataFrame, options: Options | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each archive: format, entries, the charset of its names, or why it does not open."""
    opts = options or Options()

    def make(p: str | None, b) -> Iterator[dict]:
        row = {"archive_path": p, "length": len(b), "volume_set": [p] if p else None}
        try:
            a = reader.open_archive(b, p, opts)
            row |= {"format": a.format, "entry_count": len(a.entries), "name_encoding": a.name_encoding}
        except reader.ArchiveError as e:
            row["error"] = reader.error_of(e)
        yield row

    return _mapped(files, make, ARCHIVES, path, content)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as (path, content) through Spark's own reader, so any store that Spark reads will do. Split volumes are joined."""
    return joined_volumes(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def joined_volumes(files: DataFrame) -> DataFrame:
    """Rows of byte-split sets (.001, .002, ...) as one row under the first volume's path; a gap ends the set."""
    number = F.regexp_extract("path", r"\.(\d{3,})$", 1)
    marked = files.select("path", "content", F.when(number != "", number.cast("int")).alias("__n"), F.when(number != "", F.regexp_replace("path", r"\.\d{3,}$", "")).alias("__stem"))
    plain = marked.where(F.col("__n").isNull()).select("path", "content")
    parts = marked.where(F.col("__n").isNotNull()).groupBy("__stem").agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), "path", "content"))).alias("v"))
    whole = parts.withColumn("v", F.filter("v", lambda x, i: x["n"] == i + 1)).where(F.size("v") > 0)
    return plain.unionByName(whole.select(F.concat("__stem", F.lit("")).alias("path"), F.expr("aggregate(v, cast('' as binary), (a, x) -> concat(a, x.content))").alias("content")))


def _listed(paths: list[str]) -> str:
    """The path under which an archive or a volume set is listed."""
    if len(paths) > 1 and paths[-1].lower().endswith((".zip", ".zipx")):
        return paths[-1]
    return paths[0].removesuffix(".001")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArchiveReader(DataSourceReader):
    """One partition for each archive or volume set under a path."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}

    def _wanted(self, row: dict) -> bool:
        """Whether the options ask for an entry; rows of archives that do not open always pass."""
        if row.get("index") is None:
            return True
        kind, prefix, index = (self.options.get(k) for k in ("kind", "nameprefix", "index"))
        return (kind is None or row["kind"] == kind) and (prefix is None or row["name"].startswith(prefix)) and (index is None or row["index"] == int(index))

    def partitions(self):
        import glob
        import os

        path = self.options.get("path", "")
        path = path[len("file://") :] if path.startswith("file://") else path.removeprefix("file:")
        found = sorted(p for g in glob.glob(path) for p in ([g] if os.path.isfile(g) else (os.path.join(d, f) for d, _, fs in os.walk(g) for f in fs)))
        sets = group(found, Options().limits.max_volumes)
        return [_Part(s) for s in sets] or [_Part([])]

    def read(self, partition):
        import mmap

        opts = Options.of(self.options)
        content = self.options.get("content", "false").lower() == "true"
        if not partition.paths:
            return
        name = _listed(partition.paths)
        if len(partition.paths) == 1:
            with open(partition.paths[0], "rb") as f:
                try:
                    buf = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
                except ValueError:
                    buf = memoryview(b"")
        else:
            volumes = []
            for p in partition.paths:
                with open(p, "rb") as f:
                    volumes.append(f.read())
            buf = memoryview(b"".join(volumes))
            if partition.paths[-1].lower().endswith((".zip", ".zipx")):
                opts.volume_starts = tuple(accumulate([0, *map(len, volumes[:-1])]))
        made = (r for r in reader.rows(name, buf, opts, content, self._wanted) if self._wanted(r))
        yield from _batched(made, to_arrow_schema(self.schema))


class ArchiveSource(DataSource):
    """spark.read.format("archive").option("content", "true").load(path or glob). Paths are local or mounted on every executor; for other stores use read_files().

    The options kind, namePrefix and index narrow the entries; payloads of others are not decoded.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> T.StructType:
        return CONTENTS if self.options.get("content", "false").lower() == "true" else ENTRIES

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Registers the source.

    It takes no pushed filters: Spark keeps a reader that took some for later scans of the same frame, which
    then lack rows. What is opened and decoded is narrowed by the path and the options instead.
    """
    spark.dataSource.register(ArchiveSource)
