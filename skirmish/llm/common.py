"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch at most, and the text bytes that one step of an operator looks at.
BATCH_ROWS = 1000
SHARD_BYTES = 8 << 20
#: Bytes of an Arrow batch that Spark sends to a worker, beyond which the next row begins another.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return df["`" + name.replace("`", "``") + "`"]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with some settings changed (dots written as __), which are put back at the end."""
    own = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str]):
    """Hand batches of at most ``BATCH_ROWS`` rows to a step, so that a worker's memory is set by its longest
    texts and not by the number of rows that happen to stand together; columns get their names here."""

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.rename_columns(names)
            for k in range(0, len(b), BATCH_ROWS):
                yield b.slice(k, BATCH_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(cut_up(batches))
        give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not in this C library
        pass


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of about ``BATCH_BYTES`` to its workers, or smaller ones if it did.
    For plans that the caller runs; ``cut`` bounds its own."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def map_texts(
    df: DataFrame,
    fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    /,
    **columns: str | Column,
) -> DataFrame:
    """``mapInArrow`` over the named columns only: name in the batch -> column of the input."""
    # mapInArrow reads a dot in a name as a field, so the columns go by number
    picked = [(named(df, c) if isinstance(c, str) else c).alias(f"c{k}") for k, c in enumerate(columns.values())]
    return df.select(*picked).mapInArrow(small_batches(fn, list(columns)), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster's machines share, from spark.checkpoint.dir; one of our own only
    where the session names none, as in local tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="skirmish-checkpoints-"))
    return sc.getCheckpointDir()


#: Lets Spark delete an action's shuffle files as the action ends, and bounds what it sends to workers at once.
_FREE = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true", _BATCH.replace(".", "__"): f"{BATCH_BYTES}b"}


def cut(df: DataFrame) -> DataFrame:
    """Run the plan so far and go on from its rows, written to the shared folder, so that a lost executor
    costs a reread and not a recomputation.  The shuffles that led to it are deleted at once; ``drop``
    deletes the rows when nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with settings(spark, **_FREE):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete the rows that ``cut`` wrote."""
    for df in cuts:
        delete_folder(df.sparkSession, df.cut_at)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, without decoding; null is the empty text."""
    column = batch.column(name).cast(pa.large_binary())
    return [t or b"" for t in column.to_pylist()]


def shards(sizes: Iterable[int], limit: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows of the given sizes into runs of about ``limit``: (first, end)."""
    first = total = n = 0
    for n, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield first, n
            first, total = n, 0
    if first < n:
        yield first, n


def remainder_of(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus
