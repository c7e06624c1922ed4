"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch for small_batches(), beyond which only a single row can go.
ARROW_BYTES = 4 << 20

#: What empties the stores that an operator keeps in a Python worker from task to task, by operator.
_kept: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder in use: the session's ``spark.checkpoint.dir``.

    Only where none is set, and the master is a local one, a temporary folder serves (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="stowage-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns a frame that reads it, for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet under the shared checkpoint folder and returns a frame that reads it, for texts."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on Spark sends texts to Python workers by ARROW_BYTES at most, where it would by more; executor and worker hold a batch each, and often its results."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def _bytes(size: str) -> int:
    """Of a setting such as 64m; Spark writes plain bytes as 67108864b."""
    size = size.lower().rstrip("b")
    digits = size.rstrip("kmgtp")
    return int(digits) << 10 * " kmgtp".index(size[len(digits) :] or " ")


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Says that the operator's stores stay in this worker after its task, until drop() is called."""
    _kept[operator] = drop


def drop_others(operator: str) -> None:
    """Empties what other operators have kept in this worker: Spark hands workers on from stage to stage."""
    if others := [k for k in _kept if k != operator]:
        for k in others:
            _kept.pop(k)()
        tidy()


def tidy() -> None:
    """Hands memory that a task has freed back to the system; idle Python workers count against their executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
