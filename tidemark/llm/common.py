"""What the operators share: tables, the shared folder, Arrow batches in pieces, labelled samples."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 4 << 20
LARGE = 1 << 20  # bytes of memory that a worker maps alone, and so gives back as soon as they are free
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3  # of mallopt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written to the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run`, but what it frees goes back to the system: Spark uses workers again, also for other stages.

    Large arrays of numpy and Arrow go back at once. By default glibc keeps up to 64 MB of them, having seen large ones
    freed, and Arrow's allocator some more, which a task then holds beside what it needs. The rest goes back at the end.
    """

    def whole(batches: Batches) -> Batches:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(M_MMAP_THRESHOLD, LARGE)
            libc.mallopt(M_TRIM_THRESHOLD, LARGE)
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): text i is bytes[bounds[i]:bounds[i + 1]]; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most `most` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start, total = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, "right")))
            yield batch.slice(start, stop - start)
            start, total = stop, int(ends[stop - 1])


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    column: str,
    modulus: int,
    remainder: int,
    rows: int,
    most_bytes: int,
) -> DataFrame:
    """text, y of at most `rows` labelled documents outside the held-out fold, in one partition, for fitting.

    The documents are those with the smallest hashes of doc_id among the labelled ones, so reruns
    agree. A text over `most_bytes` bytes is not sampled, which bounds the partition to
    rows * most_bytes bytes. A document labelled more than once has its highest label; null labels,
    null ids and null texts do not count.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(column).cast("long").alias("y"))
        .filter(~held_out("doc_id", modulus, remainder))
        .join(docs.select("doc_id"), "doc_id", "left_semi")  # labels may cover other documents too
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(4 * rows)
    )
    return (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
        .join(F.broadcast(picked), "doc_id")  # 4 * rows ids at most
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
        .limit(rows)
        .select("text", "y")
    )


def fitted(sample: DataFrame, fit: Callable[[pa.Array, np.ndarray], object]):
    """What `fit` makes of a sample's (texts, labels), in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("y", pa.int64())]))
        if found.num_rows:
            model = fit(found.column("text").combine_chunks(), found.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    models = sample.mapInArrow(frugal(run), "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fit(pa.array([], pa.string()), np.empty(0, np.int64))
