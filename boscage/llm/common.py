"""Helpers shared by the operators: tables, checkpoints and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at together.
SLICE_BYTES = 2 << 20
#: MB up to which a side of a join is broadcast.
BROADCAST_MB = 32
#: ASCII letters in lower case, digits and all bytes beyond ASCII as they are, else a blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset on one machine (tests) a
    temporary folder takes its place; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="boscage-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths in the shared folder that are written and not yet released.
_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def release(spark: SparkSession, *paths: str) -> None:
    """Delete what was written at ``paths``."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _written:
            _written.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within is deleted at the end, when the results have been written elsewhere."""
    before = set(_written)
    try:
        yield
    finally:
        release(spark, *[p for p in _written if p not in before])


def local_path(uri: str) -> str | None:
    """The file-system path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith(os.sep) else None


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place, so that no two names clash."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The columns of exactly these names, cast; of several with one name, the first. Other columns may have any name."""
    return flat(df).select(*[F.col(f"c{df.columns.index(name)}").cast(kind).alias(name) for name, kind in kinds.items()])


def id_text(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string")


def keep_rows(docs: DataFrame, decider: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """The rows whose text is decided to stay, all columns as they are; rows move nowhere. A task calls ``decider`` once."""
    plain, at = flat(docs), docs.columns.index("text")

    def run(batches):
        decide = decider()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield part.filter(pa.array(decide(part.column(at).cast(pa.string())), pa.bool_()))
        del decide
        tidy()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def join_side(df: DataFrame, side: DataFrame, on: str, how: str, row_bytes: int) -> DataFrame:
    """Join ``df`` with a ``side`` that is broadcast if it is small enough, and else hashed after a shuffle."""
    side = checkpoint(side)
    small = side.count() * row_bytes <= BROADCAST_MB << 20
    return df.join(F.broadcast(side) if small else side.hint("shuffle_hash"), on, how)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``gone``; of rows with the same doc_id and text, one.

    Rows with a null doc_id stay.
    """
    key, text = f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"
    left = join_side(flat(docs), gone.select(F.col("doc_id").alias(key)), key, "left_anti", 16)
    again = checkpoint(left.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if not again.isEmpty():
        left = join_side(left, again, key, "left_anti", 16).unionByName(join_side(left, again, key, "left_semi", 16).dropDuplicates([key, text]))
    return left.toDF(*docs.columns)


def as_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def byte_lengths(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def tidy() -> None:
    """Give memory that a task no longer needs back to the system, as workers live on for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``limit`` bytes of text each.

    A row is never split, so one very long text makes a part of its own.
    """
    n = batch.num_rows
    if not n:
        return
    upto = np.cumsum(byte_lengths(batch.column(column)))
    start = 0
    while start < n:
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array end to end, and each row's offsets; nulls are empty."""
    text = pc.fill_null(text, "").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
