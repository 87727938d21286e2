"""Line deduplication by range-partitioned line hashes.

Every document gives one row for each distinct line key: a 128-bit hash, the document and the
lines' positions. Rows are range-partitioned by (hash, document), with a secondary sort by
document, and streamed: a run of equal hashes is met document by document, so that first
occurrences and the count of documents come out of one pass that holds at most
``min_docs - 1`` rows of a run. A key with more rows than one partition is dealt over several
by its documents; the runs at the two ends of a partition may go on next door, so their counts
are settled by a join with at most two small rows for each partition. What comes back is one
zlib-compressed keep bitmap for each document that loses lines, never text.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = b" \t\n\x0b\x0c\r"


def _line_rows(min_chars: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, fps, his, los, ats = [], [], [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            found: dict[bytes, list[int]] = {}
            for at, line in enumerate((text or "").encode().lower().split(b"\n")):
                key = line.strip(SPACE)
                if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                    found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
            for digest, at in found.items():
                hi, lo = struct.unpack(">qq", digest)
                ids.append(i), his.append(hi), los.append(lo), ats.append(at)
        take = pa.array(ids, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(his, pa.int64()), pa.array(los, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(ats, pa.list_(pa.int32()))],
            ["hi", "lo", "id", "fp", "at"],
        )

    return run


def _stream(min_docs: int):
    """Over rows sorted by (hash, document): the rows of keys in ``min_docs`` documents. A run at
    either end of the partition may go on next door: a summary row (no positions) gives its count
    here, and its rows, if too few to be sure, go out as unsure. That are fewer than ``min_docs``
    rows at each end, however long the run."""
    names = ["hi", "lo", "id", "fp", "at", "sure", "docs"]

    def out(rows: pa.RecordBatch, sure: bool) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([sure] * n), pa.nulls(n, pa.int64())], names)

    def ended(held: list[pa.RecordBatch], last: pa.RecordBatch, docs: int):
        for x in held:
            yield out(x, False)
        one = last.slice(last.num_rows - 1)
        blank = [pa.nulls(1, one.schema.field(k).type) for k in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *blank, pa.array([False]), pa.array([docs], pa.int64())], names)

    def run(batches):
        key, docs, last, first = None, 0, None, True
        held: list[pa.RecordBatch] = []  # fewer than min_docs rows of the present run
        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                rows = batch.slice(a, b - a)
                if (hi[a], lo[a]) != key:
                    if key is not None and first:
                        yield from ended(held, last, docs)
                        first = False
                    key, docs, held = (hi[a], lo[a]), 0, []
                docs, last = docs + rows.num_rows, rows
                if docs < min_docs:
                    held.append(rows)
                else:
                    for x in (*held, rows):
                        yield out(x, True)
                    held = []
        if key is not None:
            yield from ended(held, last, docs)

    return run


def _once(batches):
    """Rows that repeat (hash, document) follow each other after the sort: one stays."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()]
        ids = batch.column(2)
        same = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
        for k in np.flatnonzero(same):
            same[k] = ids[k].as_py() == ids[k + 1].as_py()
        now = (*(c[0] for c in cols), ids[0].as_py())
        keep = np.concatenate([[now != before], ~same])
        before = (*(c[-1] for c in cols), ids[-1].as_py())
        yield batch if keep.all() else batch.filter(pa.array(keep))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, partitions: int | None = None) -> DataFrame:
    """(id, fp, dropped array<int>'s bitmap) of the documents that lose lines.

    A key of at least ``min_chars`` code points found in ``min_docs`` documents loses all its
    lines. ``keep`` is zlib over bits, first line first; bits past its end are kept lines.
    Null or empty text is one empty line; ids may be null; rows that repeat id and text count
    as one document; an empty table gives an empty one; other columns are not looked at."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    lines = C.map_batches(src, _line_rows(max(min_chars, 1)), f"hi long, lo long, id {id_type}, fp long, at array<int>")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "hi", "lo", "id", "fp").sortWithinPartitions("hi", "lo", "id", "fp")
    stream = _stream(min_docs)
    hits = C.cut(ranged.mapInArrow(lambda batches: stream(_once(batches)), f"hi long, lo long, id {id_type}, fp long, at array<int>, sure boolean, docs long"), "line-hits", docs.count(), 2000)
    enough = hits.where("docs IS NOT NULL").groupBy("hi", "lo").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    rows = hits.where("docs IS NULL")
    unsure = rows.where("NOT sure").join(F.broadcast(enough), ["hi", "lo"], "left_semi")  # two rows a partition at most
    gone = rows.where("sure").select("id", "fp", "at").unionByName(unsure.select("id", "fp", "at"))
    return gone.groupBy("id", "fp").agg(F.flatten(F.collect_list("at")).alias("at")).mapInArrow(_bitmap_batches, f"id {id_type}, fp long, n_dropped long, keep binary")


def _bitmap_batches(batches):
    for batch in batches:
        keep, n = [], []
        for at in batch.column(2).to_pylist():
            bits = np.ones(max(at) + 1, np.uint8)
            bits[at] = 0
            keep.append(zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8]), 1))
            n.append(int(len(bits) - bits.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keep, pa.binary())], ["id", "fp", "n_dropped", "keep"])


def _apply(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    out = []
    for text, keep in zip(texts, keeps, strict=True):
        if keep is None:
            out.append(text)
            continue
        raw = zlib.decompress(keep)
        bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
        bits = bits[: len(bits) - (8 - raw[-1]) % 8]
        out.append("\n".join(x for i, x in enumerate((text or "").split("\n")) if i >= len(bits) or bits[i]))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the text that is left, and two more columns, ``__n_lines`` and ``__n_dropped``.

    All rows and columns of ``docs`` stay; a text that loses nothing stays as it is (null too)."""
    maps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars)
    src = C.packed(docs, F.col(f"`{id_col}`").alias("own"), F.xxhash64(f"`{text_col}`").alias("print"), F.col(f"`{text_col}`").alias("text"))
    joined = src.join(maps, F.col("own").eqNullSafe(F.col("id")) & (F.col("print") == F.col("fp")), "left")
    left = F.pandas_udf(_apply, "string")(F.col("text"), F.col("keep"))
    lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    results = {text_col: left, "__n_lines": lines.cast("long"), "__n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long")}
    out = C.unpacked(joined, docs.columns, **results)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("__n_lines", "__n_dropped")], "__n_lines", "__n_dropped")
