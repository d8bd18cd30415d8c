"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step works on at once.
BATCH_BYTES = 12 << 20
#: Rows of a batch that settled steps hand to Python, which bounds what is held outside the heap.
BATCH_ROWS = 4000
#: Settings of a session while a step is written.
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCHES: str(BATCH_ROWS)}
#: Text bytes that one bucket of a shuffle of whole texts stands for at most, on average.
BUCKET_BYTES = 256 << 20
#: Rows, of some numbers each, of a table that is broadcast at most.
BROADCAST_ROWS = 200_000
#: Bits of a bitmap that is broadcast, as a power of two, whatever the number of things it stands for: 16 MB. Bits of one of its rows, as Spark's functions have them.
BITMAP_BITS, BITMAP_ROW = 27, 32_768
#: A word as the contracts count it: a run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(key: str, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n: the folds of the labelled rows."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def buckets_for(docs: DataFrame) -> int:
    """Buckets that a shuffle of all texts of docs (column text) is dealt to.

    As many as the session's shuffle partitions, and more where a bucket would else stand for over
    BUCKET_BYTES of text: what a task holds does not grow with the table.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The setting of the session is used as it is. Where it is unset, a session on one machine takes a folder beside its warehouse; on a
    cluster, where that may be a folder of the driver alone, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_open = threading.local()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread settles inside are deleted as it ends, whether well or not, but for those that are passed to what it gives; these are its surroundings' from then on.

    What leaves a scratch must be settled itself: a plan that still reads a table of it fails.
    """
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._settled)
        return df

    outer, own = getattr(_open, "tables", None), {}
    _open.tables = own
    try:
        yield keep
    finally:
        _open.tables = outer
        for path, spark in own.items():
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer[path] = spark


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_writing = threading.Lock()
_before: list[dict] = []


@contextmanager
def _written(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold as long as any thread writes: the first sets them, the last puts back what was there."""
    with _writing:
        _before.append({key: spark.conf.get(key, None) for key in SETTINGS} if not _before else {})
        for key, value in SETTINGS.items() if len(_before) == 1 else ():
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _writing:
            if len(_before) > 1:
                _before.pop()
            else:
                for key, value in _before.pop().items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def settle(df: DataFrame, batch_rows: int | None = None, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors lose nothing. batch_rows: rows of a batch that this step hands to Python, where rows are large.

    The shuffle files of the writing query are removed as it ends, so what is on disk
    at a time is one step's shuffle and the settled tables.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if getattr(_open, "tables", None) is not None:
        _open.tables[path] = spark
    with _written(spark):
        if batch_rows:
            spark.conf.set(BATCHES, str(batch_rows))
        try:
            df.select("*").write.option("compression", compression).parquet(path)
        finally:
            if batch_rows:
                spark.conf.set(BATCHES, SETTINGS[BATCHES])
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def looked_up(table: DataFrame) -> DataFrame:
    """A settled table of few narrow columns for a join: broadcast where its rows are few, else left to be shuffled.

    A plain shuffle of a settled table is one that adaptive execution can split where a key is hot.
    """
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def forget(*frames: DataFrame) -> None:
    """Delete tables, as `settle` gave them, that no later step reads."""
    for df in frames:
        _delete(df.sparkSession, df._settled)


def bitmap(bits: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with the bits that the column `bit` of bits names set: rows of it are made by aggregation, 16 MB of them in all at most."""
    rows = bits.groupBy(F.expr(f"bit div {BITMAP_ROW}").alias("row")).agg(F.expr(f"bitmap_construct_agg(bit % {BITMAP_ROW})").alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in rows:
        out[row["row"] * (BITMAP_ROW // 8) : (row["row"] + 1) * (BITMAP_ROW // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def is_set(bytes_: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bytes_[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of at most `rows` rows whose texts are about `limit` bytes together; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = batch.column(at)
        if text.null_count:
            batch = batch.set_column(at, batch.schema.field(at), pc.fill_null(text, b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else ""))
            text = batch.column(at)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the n + 1 bounds of the rows."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    start = int(offsets[column.offset])
    data = column.buffers()[2]
    if data is None or not bounds[-1]:
        return np.zeros(0, np.uint8), bounds
    return np.frombuffer(data, np.uint8)[start : start + int(bounds[-1])], bounds
