"""Helpers that the operators share: shared scratch tables, row numbers, Arrow batches.

Identity rule for every operator here: a row is a document of its own. ``doc_id`` orders documents; those without an id
come after all others, among themselves by a hash of the text. Rows of one id are neither earlier nor later than
each other, whatever their texts. Any 64-bit number may be an id: a missing one is a flag, never a number.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shipping import ship

#: Text bytes that one numpy step works on.
CHUNK_BYTES = 4 << 20

#: Up to so many 8-byte ids are broadcast (16 MB at most); more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, else of the context's checkpoint folder. A temporary one only on a local master (tests): elsewhere executors couldn't share it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        of_context = sc._jsc.sc().getCheckpointDir()
        root = of_context.get() if of_context.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _roots.get(sc.applicationId) or "file://" + tempfile.mkdtemp(prefix="blockloom-")
        _roots[sc.applicationId] = root
    root = f"{root.rstrip('/')}/blockloom-{sc.applicationId}"
    if root not in _roots:
        _roots[root] = root
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at exit: the session may be gone already."""
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001
        pass


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, records: int = 4000):
    """While a step runs: Arrow batches are small, whatever the length of a text, and the step's shuffle files go when it ends. The session's own settings come back after."""
    ship(spark)
    own = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(records),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(CHUNK_BYTES),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, records: int = 4000) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, records):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        if path := vars(df).pop("_scratch", None):
            delete(df.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def id_of(id_col: str) -> Column:
    return F.col(f"`{id_col}`").cast("long")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text not null), whatever other columns there are."""
    return df.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def ordered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, late, ord, text): documents come in order of (late, ord)."""
    own = keyed(df, id_col, text_col)
    return own.select("doc_id", F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.xxhash64("text")).alias("ord"), "text")


def numbered(df: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """The table with a number for every row, written once so that all later steps see the same numbers; and the new column's name."""
    row = unused(df, name)
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def rank_of(late: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """Dense ranks by (late, ord); rows of one id share one."""
    by = np.lexsort((ord_, late))
    new = np.concatenate(([0], (late[by][1:] != late[by][:-1]) | (ord_[by][1:] != ord_[by][:-1]))).astype(np.int64)
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new[: len(by)])
    return out


def numbers(column: pa.Array) -> np.ndarray:
    """An integer or boolean column without nulls, as int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its offsets (from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets from lengths: n + 1 values from 0."""
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every piece, one piece after the other."""
    at = spans_of(lengths)
    return np.arange(at[-1], dtype=np.int64) + np.repeat(starts - at[:-1], lengths)


def same_slices(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Are raw[a:a+n] and raw[b:b+n] the same bytes? For arrays of slices, some hundred KB at a time."""
    out = np.ones(len(a), bool)
    at = spans_of(n)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
        # a single slice of any length is compared as it stands
        if j == i + 1:
            out[i] = bool((raw[a[i] : a[i] + n[i]] == raw[b[i] : b[i] + n[i]]).all())
        else:
            wrong = raw[ragged(a[i:j], n[i:j])] != raw[ragged(b[i:j], n[i:j])]
            total = np.concatenate(([0], np.cumsum(wrong)))
            out[i:j] = total[at[i + 1 : j + 1] - at[i]] == total[at[i:j] - at[i]]
        i = j
    return out


def few(rows: DataFrame) -> DataFrame:
    """Broadcast ids only where they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
