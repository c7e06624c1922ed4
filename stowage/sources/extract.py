"""Extraction to a file system: one task for each archive, in a safe order, failures as rows."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import MICRO, ArchiveError, Options, malformed
from . import names, reader

RESULT = T.StructType([T.StructField(n, k) for n, k in (("archive_path", T.StringType()), ("index", T.IntegerType()), ("written", T.StringType()), ("bytes", T.LongType()), ("error", T.StringType()))])


def _inside(root: str, path: str) -> str:
    """The path, if no symbolic link on the way leads out of the root."""
    parent = os.path.realpath(os.path.dirname(path))
    if os.path.commonpath([parent, os.path.realpath(root)]) != os.path.realpath(root):
        raise malformed("path leaves the destination")
    return path


def _place(data: bytes, target: str, overwrite: bool) -> None:
    """Written under another name first, so that a file is there whole or not at all."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if os.path.lexists(target) and not overwrite:
        raise ArchiveError("io", "file exists")
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(target))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temp, target)
    except BaseException:
        os.unlink(temp)
        raise


def extract_archive(path: str | None, buf, root: str, opts: Options, overwrite: bool = False) -> Iterator[dict]:
    """Files and links first, then links to what came later, resource forks, and directories with the deepest first."""
    try:
        archive = reader.open_archive(buf, path, opts)
    except ArchiveError as e:
        yield {"archive_path": path, "error": e.code}
        return
    done: dict[str, str] = {}

    def phase(e) -> tuple:
        parts = names.components(e.name)
        if e.kind == "directory":
            return 3, -len(parts), e.index
        return (2 if e.extra.get("fork") == "rsrc" else 0), 0, e.index

    todo = sorted(archive.entries, key=phase)
    later = []
    for e in [*todo, None]:
        if e is None:
            break
        yield from _one(path, e, root, opts, overwrite, done, later)
    for e in later:
        yield from _one(path, e, root, opts, overwrite, done, None)


def _one(path, e, root: str, opts: Options, overwrite: bool, done: dict[str, str], later) -> Iterator[dict]:
    row = {"archive_path": path, "index": e.index, "written": None, "bytes": None, "error": None}
    try:
        parts = names.safe_path(e.name)
        if parts is None:
            raise malformed("unsafe path")
        target = os.path.join(root, *parts)
        os.makedirs(root, exist_ok=True)
        if e.kind == "directory":
            os.makedirs(target, exist_ok=True)
            _inside(root, os.path.join(target, "x"))
            row["bytes"] = 0
        elif e.kind == "hardlink" and (to := names.safe_path(e.extra.get("linkPath", ""))):
            source = done.get("/".join(to))
            if source is None:
                if later is not None:
                    later.append(e)
                    return
                raise ArchiveError("notFound", "link target")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.link(source, _inside(root, target))
            row["bytes"] = 0
        elif e.kind == "symlink":
            to = e.extra.get("linkPath") or reader.payload(e, opts).decode("utf-8", "replace")
            if not to or "\0" in to or to.startswith("/") or os.path.commonpath([os.path.realpath(os.path.join(os.path.dirname(target), to)), os.path.realpath(root)]) != os.path.realpath(root):
                raise malformed("link leaves the destination")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.symlink(to, _inside(root, target))
            row["bytes"] = 0
        else:
            if e.extra.get("fork") == "rsrc":
                target += ".rsrc"
            data = reader.payload(e, opts)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            _place(data, _inside(root, target), overwrite)
            row["bytes"] = len(data)
            done["/".join(parts)] = target
        if e.kind in ("file", "directory") and e.mode is not None:
            os.chmod(target, e.mode & 0o777 | 0o600)
        if e.kind in ("file", "directory") and e.mtime is not None:
            os.utime(target, (e.mtime / MICRO, e.mtime / MICRO))
        row["written"] = target
    except ArchiveError as err:
        row["error"] = err.code
    except OSError as err:
        row["error"] = f"io: {err.strerror}"
    yield row


def extract(files: DataFrame, root: str, options: Options | None = None, overwrite: bool = False, path: str = "path", content: str = "content") -> DataFrame:
    """Extracts archives given as (path, content), each below root/its own name, when the result is evaluated."""
    opts, schema = options or Options(), to_arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                where = batch.column(0)[i].as_py()
                data = batch.column(1)[i].as_buffer()
                own = os.path.join(root, os.path.basename(where or "archive") + ".d")
                made = list(extract_archive(where, memoryview(data) if data is not None else b"", own, opts, overwrite))
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    return files.select(path, content).mapInArrow(run, RESULT)
