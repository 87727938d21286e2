"""Shared plumbing of the corpus operators: scratch tables, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or the one that the context was given. Where
    neither is named, a folder of our own on a single machine (tests); on a cluster that is an error,
    as its machines share no folder that we could choose."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not (own := os.environ.get("LODESTREAM_SCRATCH")):
        own = os.environ["LODESTREAM_SCRATCH"] = tempfile.mkdtemp(prefix="lodestream-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


#: Most rows that Spark may hand to Python at once: an Arrow batch of long rows stands in an
#: executor's memory several times over, outside its heap.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ARROW_ROWS if it is larger. What an operator returns
    runs later, in that session, so the setting has to stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def cut(df: DataFrame, name: str, rows: int | None = None, rows_per_file: int = 10_000) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    so a lost executor costs a reread and never a recomputation of what came before. Where a
    bound on its rows is known, small tables get few files (large ones keep their partitions)."""
    spark = df.sparkSession
    at = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    if rows is not None and (few := max(1, -(-rows // rows_per_file))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(few)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Bytes of text whose blocks share a bucket, and that a task makes blocks of at least.
BUCKET_BYTES, TASK_BYTES = 256 << 20, 4 << 20


def bucketed(docs: DataFrame, text_col: str, blocks: Callable[[DataFrame], DataFrame], key: str, name: str) -> DataFrame:
    """What ``blocks`` makes of ``docs``, as a table in the shared folder bucketed by ``key``: what is
    grouped by the key meets it without moving it. There are as many buckets as the texts fill, and no
    fewer than shuffle partitions. The catalog forgets the table at once; its files stay like those of
    ``cut``. Small partitions of ``docs`` are joined first, so that small tables get few files."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    blocks = blocks(docs.coalesce(max(1, -(-n_bytes // TASK_BYTES))))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    own = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, key).option("path", f"{scratch_dir(spark).rstrip('/')}/{own}").option("compression", "none").saveAsTable(own)
    made = spark.table(own)
    spark.sql(f"DROP TABLE {own}")
    return made


def with_small(left: DataFrame, right: DataFrame, key: str, most_rows: int = 2_000_000) -> DataFrame:
    """Inner join; ``right`` (a key and a few numbers a row) is broadcast if counted below
    ``most_rows``, else both sides are shuffled and AQE splits what is skewed."""
    return left.join(F.broadcast(right) if right.count() <= most_rows else right, key)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows end to end, n + 1 offsets) of a string column; null is empty.
    Both are views of Arrow's buffers where the column has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(rows, text, most: int = 2 << 20):
    """(rows, texts) slices with about ``most`` bytes of text each; a longer row is a slice of its own."""
    _, off = text_bytes(text)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield rows.slice(at, to - at), text.slice(at, to - at)
        at = to


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = 2 << 20, text_col: int = -1) -> DataFrame:
    """``f`` over slices of a bounded amount of text; ``df`` has columns of the operator's own."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part, _ in pieces(batch, batch.column(text_col % batch.num_columns), most) if batch.num_rows else ():
                yield f(part)

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` as the one column ``row``, so that none can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The columns of ``row`` with the results after them; a result takes the place of a column of its name."""
    own = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in {k.lower() for k in results}]
    return df.select(*own, *[v.alias(k) for k, v in results.items()])


def map_docs(docs: DataFrame, text_col: str, f: Callable[[pa.Array], list[pa.Array]], results: str, most: int = 2 << 20) -> DataFrame:
    """``docs`` with result columns (a DDL string) that ``f`` makes from slices of the text column."""
    small_batches(docs.sparkSession)
    src = packed(docs)
    out = StructType.fromDDL(results)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            for own, text in pieces(rows, rows.field(at), most) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([own, *f(text)], ["row", *(x.name for x in out)])

    made = src.mapInArrow(run, StructType([*src.schema.fields, *out.fields]))
    return unpacked(made, docs.columns, **{x.name: F.col(x.name) for x in out})


#: Bytes to lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def word_spans(is_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that never cross a row's bounds, and each row's first run."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[off[:-1]] = True
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1 : n + 1])) + 1 if n else starts
    if n and is_word[-1] and (not len(ends) or ends[-1] != n):
        ends = np.append(ends, n)
    return starts, ends, np.searchsorted(starts, off)


def _mix2(x: np.ndarray) -> np.ndarray:
    """Two rounds of the finaliser: no structure of the input is left."""
    x = mix(x) * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


#: Spans longer than this many bytes are hashed one by one.
_LONG_SPAN = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[start:end] for each span. Short spans go side by side, eight bytes
    a step, each step through a mixer that isn't linear; long ones through xxh3."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    out = mix(n.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
    live, done = np.arange(len(n)), 0
    while len(live):
        chunk, left = eight[starts[live] + done], n[live] - done
        part = left < 8
        if part.any():
            chunk[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        out[live] = _mix2(out[live] ^ mix(chunk + np.uint64(0xE7037ED1A0B428DB)))
        done += 8
        live = live[(left > 8) & (n[live] <= _LONG_SPAN)]
    for k in np.flatnonzero(n > _LONG_SPAN):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))
