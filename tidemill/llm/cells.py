"""Exchange of many small records as packed cells.

A map task writes its records (a numpy structured array) as one binary cell per bucket, so Spark
moves a few thousand rows instead of tens of millions.  A bucket comes from a hash of the record's
key: equal keys meet in one task, which reads its cells as one array and sorts it.  Every map chunk
first folds its own repeats into one record, so a key held by a third of all rows costs one record
per chunk and no task gets an unbounded group.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.textvec import row_chunks

CELLS = "bucket int, cell binary"
ARROW = pa.schema([("bucket", pa.int32()), ("cell", pa.binary())])
#: Rows here are whole texts, and both sides of the pipe to Python hold a batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: While a table of ours is written: small batches, and shuffle files go when the write ends.
WRITING = {BATCH: "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings, which it gets back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(spark: SparkSession) -> SparkSession:
    """For queries, which return frames that Spark runs later: batches of 1,000 rows where the session has Spark's default of 10,000.  Operators leave the session as it is."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, WRITING[BATCH])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only on a local master, where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_tidemill_dir", None)
        if not found:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = spark.sparkContext._tidemill_dir = tempfile.mkdtemp(prefix="tidemill-")
    return found.rstrip("/")


_USED: dict[str, SparkSession] = {}


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, in whatever store it is."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def _discard_all() -> None:
    for path, spark in _USED.items():
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder then stays
            pass


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    Tables of one application share a folder, which goes when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}"
    if folder not in _USED:
        if not _USED:
            atexit.register(_discard_all)
        _USED[folder] = spark
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.saved_at = path
    return out


def packed(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that has records.  A batch holds 2 GiB at most; more, which one text of some 100 MB can make, is an error and not cut off."""
    if records.nbytes >= 1 << 31:
        raise ValueError(f"{len(records)} records of {records.dtype.itemsize} bytes do not fit a batch: a text is too long")
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    offsets = (np.r_[starts, len(bucket)] * records.dtype.itemsize).astype(np.int32)
    cell = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), cell], schema=ARROW)


def unpacked(column, dtype: np.dtype) -> np.ndarray:
    """All records of a column of cells."""
    parts = [np.frombuffer(x, dtype) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) for x in cell_bytes(c)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def cell_bytes(array) -> list[bytes]:
    return [x.as_buffer() for x in array if x.is_valid]


#: Bytes of records that a bucket, and of texts that a group of documents, should hold.
BUCKET_BYTES, GROUP_BYTES = 1 << 24, 1 << 22


def buckets_for(spark: SparkSession, total: int) -> int:
    """How many buckets records of so many bytes are dealt to: one per partition, or more where these would be large."""
    return max(partitions(spark), -(-int(total) // BUCKET_BYTES))


def dealt(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """How many buckets the records of whole texts are dealt to, and how many groups the documents form, by the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = buckets_for(docs.sparkSession, total)
    return buckets, max(buckets, -(-total // GROUP_BYTES))


def gathered(cells: DataFrame, fold, out: str = CELLS, buckets: int | None = None) -> DataFrame:
    """Deal cells by bucket, one partition for each; ``fold(bucket array, cell array)`` gets all cells of a partition and yields Arrow batches."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from fold(table.column("bucket"), table.column("cell"))

    return cells.repartitionById(buckets or partitions(cells.sparkSession), "bucket").mapInArrow(run, out)


def with_buckets(bucket, column, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records, and the bucket of each."""
    parts, ids = [], []
    for b, c in zip(bucket.chunks, column.chunks, strict=True):
        for i, x in zip(b.to_pylist(), c, strict=True):
            a = np.frombuffer(x.as_buffer(), dtype)
            parts.append(a)
            ids.append(np.full(len(a), i, np.int32))
    return (np.concatenate(ids), np.concatenate(parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, dtype))


#: Bits of a bitmap of uids: 8 MB whatever the input; a fuller one lets more rows pass, and the joins behind it drop them.
MARK_BITS = 26


def marked(uids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the bit of every uid is set."""
    word = F.shiftrightunsigned("uid", 6).bitwiseAND(F.lit((1 << MARK_BITS - 6) - 1)).alias("word")
    got = uids.select(word, F.expr("shiftleft(1L, cast(uid & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # one row a word at most
    out = np.zeros(1 << MARK_BITS - 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def has_mark(marks: np.ndarray, uid: np.ndarray) -> np.ndarray:
    at = uid.view(np.uint64)
    word = (at >> np.uint64(6) & np.uint64((1 << MARK_BITS - 6) - 1)).astype(np.int64)
    return marks.view(np.uint64)[word] >> (at & np.uint64(63)) & np.uint64(1) > 0


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row as struct ``row`` (all columns but the text) beside uid (a hash of id and text), doc_id and text: no names can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others).alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only uid and text, for a pass that makes cells."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(text_col).cast("string").alias("text"))


NULL_ID = np.iinfo(np.int64).min


def ids(column) -> np.ndarray:
    """A long column; null sorts before all others."""
    return pc.fill_null(column, int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64) if not isinstance(column, pa.ChunkedArray) else ids(column.combine_chunks())


def home(uid: np.ndarray, groups: int) -> np.ndarray:
    """The document group of each uid, or of its low 32 bits."""
    return ((uid.astype(np.int64) & 0xFFFFFFFF) % groups).astype(np.int32)


def with_home(docs: DataFrame, groups: int) -> DataFrame:
    return docs.withColumn("bucket", (F.col("uid").bitwiseAND(F.lit(0xFFFFFFFF)) % F.lit(groups)).cast("int"))


#: Text bytes that a task's numpy steps hold at once.
CHUNK = 1 << 20


def beside(docs: DataFrame, cells: DataFrame, work, schema, dtype: np.dtype) -> DataFrame:
    """``work(docs chunk, records)`` on each document group and the records addressed to it, chunk by chunk.

    Records are sorted, so ``located`` finds those of a chunk's documents.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        records = np.sort(unpacked(right.column("cell"), dtype))
        return pa.concat_tables([work(t, records) for t in row_chunks(left.to_batches(), CHUNK)] or [work(left, records)])

    return docs.groupBy("bucket").cogroup(cells.groupBy("bucket")).applyInArrow(run, schema)


def located(own: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of each document: the document's index, and the record's, for each match.

    ``own`` has a document's key fields, in the order in which they lead the sorted records.
    """
    lead = records[list(own.dtype.names)] if own.dtype.names else records["uid"]
    names, start, count = np.unique(np.ascontiguousarray(lead).astype(own.dtype), return_index=True, return_counts=True)
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(names, own), len(names) - 1)
    reps = np.where(names[i] == own, count[i], 0)
    at = np.repeat(start[i], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    return np.repeat(np.arange(len(own)), reps), at


def once(uid: np.ndarray) -> np.ndarray:
    """True where a uid is first: a row listed twice in a chunk counts there once."""
    first = np.zeros(len(uid), bool)
    first[np.unique(uid, return_index=True)[1]] = True
    return first


EMPTY = pa.Table.from_batches([], schema=ARROW)
