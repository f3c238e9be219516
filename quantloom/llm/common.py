"""Helpers shared by the corpus operators: stored tables, Arrow text buffers and hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local``) may leave it unset: a folder of this process is used then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is unset, and the executors of {master!r} share no folder with the driver")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quantloom-")
    return "file://" + _OWN["dir"]


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of what is executed within are deleted as it ends: once a table is stored nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantloom-{tag}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(_hadoop_path(spark, path))  # with the application, not before: results are lazy
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def store_bucketed(df: DataFrame, tag: str, column: str) -> DataFrame:
    """Like :func:`store`, as a table in buckets of ``column``: grouping it by that column moves nothing.

    Rows go to the files of their buckets from where they are, without a shuffle.
    """
    spark = df.sparkSession
    name = f"quantloom_{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with cleaned(spark):
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    _file_system(spark, path).deleteOnExit(_hadoop_path(spark, path))
    return spark.table(name)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Remove a table written by :func:`store` once nothing lazy reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _file_system(df.sparkSession, path).delete(_hadoop_path(df.sparkSession, path), True)


def part_count(df: DataFrame, rows: int = 5_000) -> int:
    """Into how many groups to deal what is gathered from ``df``: one for each so many rows, and one a shuffle partition at
    least, so that a group stays as large as it is however much data there is."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows)


#: Rows of an Arrow batch of whole texts: some megabytes, where Spark's own 10,000 rows can be a hundred.
BATCH_ROWS = 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, to be mapped over Arrow batches of texts: a larger batch size than BATCH_ROWS is lowered for the session."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo ``n`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def py_crc_mod(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, most: int):
    """Cut rows into runs [i, j) of about ``most`` units each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows that ``offsets`` (n+1) cut; an empty row gives 0."""
    n = len(offsets) - 1
    out = np.zeros((n,) + values.shape[1:], np.result_type(values.dtype, np.float64) if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


def quoted(name: str) -> str:
    """A column name that may hold dots, for use in expressions."""
    return "`" + name.replace("`", "``") + "`"


#: Bytes in memory up to which a table may be broadcast.
BROADCAST_BYTES = 32 << 20


def memory_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take in memory."""
    each = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            each = each + F.coalesce(F.octet_length(quoted(f.name)), F.lit(0))
        elif kind == "array":
            each = each + 64 * F.greatest(F.size(quoted(f.name)), F.lit(0))
    return df.agg(F.sum(each)).first()[0] or 0


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    return memory_bytes(df) <= most


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a stored table), marked for broadcast if its rows take no more than ``most`` bytes, else left to a shuffle."""
    return F.broadcast(df) if small(df, most) else df


#: Number of a row, unique in a table written by :func:`numbered`.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, stored, so that the rows have the same numbers each time they are read."""
    return store(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


#: SHA-256 of a row's text, by which what holds for a text is brought back to all rows that have it.
DIGEST = "__digest"


def digest(text: str = "text"):
    return F.sha2(F.col(text).cast("binary"), 256)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (numbered) whose number is not in ``gone``, without the numbers."""
    return docs.join(bounded(store(gone.distinct(), "gone")), ROW, "left_anti").select(*[quoted(c) for c in docs.columns if c != ROW])
