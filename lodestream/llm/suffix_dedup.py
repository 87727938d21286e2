"""Suffix-array dedup: repeated byte strings found by distributed prefix doubling.

Suffixes get names for their first 2, 4, 8 and 16 bytes by doubling inside a block of documents
(a name is a 64-bit fingerprint of the pair of names at offset 0 and at the growing offset, so
that equal strings have equal names everywhere). At 16 bytes Spark sorts the pairs of name and
position, packed by block, and reranks: a suffix whose name is unique is out. Pairs of names at
growing offsets then rank what is left: first the neighbourhoods of the suffixes that are not
unique (all bytes that a 50-byte string around one may cover), where one that stands in a
document with a smaller id settles all its strings at once, then each 50-byte string that is
still open. A string that also stands in a document with a smaller id marks its 50 bytes.

A settled string needs no rank: the least document with its neighbourhood has the same string
and is not settled by it, so it asks, and its id is the least that matters.

The first sort needs only sampled suffixes: of every 35 neighbouring 16-byte strings the one
with the least name, which every 50-byte string contains and which is the same wherever that
string stands. A string that stands twice therefore has a sampled suffix that is not unique, and
only suffixes next to such a sample are ranked at 50 bytes; nothing that repeats is lost.

Names travel packed: for each block and each range of names one row of sorted names, with the
block's least document for each. Such a row has at most as many names as the block has bytes,
so a string that a third of all documents share costs one entry a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED = 16
BLOCK_BYTES = 2 << 20


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_BYTE = C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def seed_names(data: np.ndarray) -> np.ndarray:
    """Names of the 16-byte strings at every byte that has 16 bytes left, by prefix doubling."""
    names = _BYTE[data]
    step = 1
    while step < SEED:
        if len(names) <= step:
            return np.zeros(0, np.uint64)
        names = _pair(names[:-step], names[step:])
        step *= 2
    return names


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of ``width``, by doubling."""
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return f(x[:-rest], x[rest:]) if rest else x


def sampled(names: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(flags of the sampled suffixes, least name of the window at each byte).

    ``starts`` flags bytes where a 50-byte string of one document begins."""
    n = len(names)
    least = np.full(n, ~np.uint64(0))
    if n >= width:
        low = _sliding(names, width, np.minimum)
        least[: len(low)] = np.where(starts[: len(low)], low, ~np.uint64(0))
    # A suffix is sampled if it is the least of a window that holds it.
    high = np.zeros(n + width - 1, np.uint64)
    high[width - 1 :] = np.where(least == ~np.uint64(0), np.uint64(0), least)
    return (_sliding(high, width, np.maximum) == names) & (names > 0), least


class _Block:
    """Documents of one block: bytes end to end, with names and the flags of whole strings."""

    def __init__(self, texts: pa.Array, length: int):
        self.data, self.off = C.text_bytes(texts)
        self.length, n = length, len(self.data)
        ends = np.repeat(self.off[1:], np.diff(self.off))
        left = ends - np.arange(n)
        self.names = seed_names(self.data)
        self.whole = left >= length
        self.flags, self.least = sampled(self.names, self.whole, length - SEED + 1)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def full_names(self, at: np.ndarray) -> np.ndarray:
        """Names of the strings of the full length at some bytes: pairs at growing offsets."""
        name, reach = self.names[at], SEED
        while reach < self.length:
            offset = min(reach, self.length - SEED)
            name = _pair(name, self.names[at + offset])
            reach = offset + SEED
        return name


def _distinct(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names and the least id of each."""
    order = np.argsort(names, kind="stable")
    names, ids = names[order], ids[order]
    edge = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    return names[edge], np.minimum.reduceat(ids, edge) if len(edge) else ids[:0]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    flat, size = np.frombuffer(zstandard.decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _ask(block: int, names: np.ndarray, ids: np.ndarray | None, ranges: int):
    """Rows (range, block, names, ids) of sorted distinct names."""
    edges = np.searchsorted(names, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64))
    for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(names)], strict=True)):
        if b > a:
            yield k, block, _pack_sorted(names[a:b]), None if ids is None else _pack(ids[a:b])


_ASK = "k int, block long, names binary, ids binary"


def _rows(rows: list, names=("k", "block", "names", "ids")) -> pa.RecordBatch:
    k, block, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(block, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], list(names))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Documents packed into blocks (block, n_bytes, docs), a table bucketed by block in the shared
    folder: what comes back to a block finds it without moving any text."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("none"))

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, _ in C.pieces(batch, batch.column(1), block_bytes) if batch.num_rows else ():
                raw, off = C.text_bytes(part.column(1))
                packed = pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), part.column(2)], ["id", "n", "none"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, packed.schema) as out:
                    out.write_batch(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([len(raw)]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([zstandard.compress(raw.tobytes(), 3)], pa.binary())],
                    ["block", "n_bytes", "head", "data"],
                )
                block += 1

    C.small_batches(spark)
    return C.bucketed(src, "text", lambda d: d.mapInArrow(run, "block long, n_bytes long, head binary, data binary"), "block", "suffix-blocks")


def _open(head: bytes, data: bytes, length: int) -> tuple[pa.RecordBatch, _Block]:
    docs = pa.ipc.open_stream(head).read_next_batch()
    raw = zstandard.decompress(data)
    off = np.concatenate([[0], np.cumsum(docs.column(1).to_numpy())]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), docs.num_rows, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw)])
    return docs, _Block(texts, length)


def _bits(answers: pa.Table, stage: int) -> np.ndarray:
    """The answers to a block's questions of a stage, in the order of the names asked."""
    rows = answers.filter(pa.compute.equal(answers["stage"], stage)).sort_by("k").to_pylist()
    return np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["n"]] for r in rows]).astype(bool) if rows else np.zeros(0, bool)


def _seeds(block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names of the sampled suffixes, sorted; which stand in several documents of the block."""
    at = np.flatnonzero(block.flags)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    names, docs = block.names[at], block.doc[at]
    order = np.lexsort((docs, names))
    names, docs = names[order], docs[order]
    edge = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    last = np.append(edge[1:], len(names)) - 1
    return names[edge], docs[edge] != docs[last]


@dataclass
class _Candidates:
    """Runs of neighbouring strings with one and the same least sampled suffix, which isn't unique:
    first and last byte where a string begins, and whether the neighbourhood of the suffix, every
    byte that one of the run's strings may cover, lies in the document (``known``) with its name."""

    first: np.ndarray
    last: np.ndarray
    known: np.ndarray
    name: np.ndarray
    doc: np.ndarray

    def strings(self, which: np.ndarray) -> np.ndarray:
        """Where the strings of some runs begin."""
        first, many = self.first[which], (self.last - self.first + 1)[which]
        return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _candidates(block: _Block, answers: pa.Table) -> _Candidates:
    names, several = _seeds(block)
    again = names[several | _bits(answers, 1)]
    n, width = len(block.least), block.length - SEED + 1
    turn = np.flatnonzero(np.concatenate([[True], block.least[1:] != block.least[:-1]])) if n else np.zeros(0, np.int64)
    least = block.least[turn] if n else np.zeros(0, np.uint64)
    found = np.isin(least, again) & (least != ~np.uint64(0))
    first, last, least = turn[found], (np.append(turn[1:], n) - 1)[found], least[found]
    samples = np.flatnonzero(block.flags)
    if not len(first) or not len(samples):
        none = np.zeros(0, np.int64)
        return _Candidates(none, none, none.astype(bool), none.astype(np.uint64), none)
    at = samples[np.minimum(np.searchsorted(samples, last), len(samples) - 1)]
    left = at - width + 1
    # The suffix serves the whole run, and its neighbourhood is inside one document.
    known = (at >= last) & (block.names[at] == least) & (left <= first) & (left >= 0) & block.whole[at]
    known &= block.doc[np.maximum(left, 0)] == block.doc[at]
    name = np.zeros(len(first), np.uint64)
    name[known] = _pair(block.full_names(left[known]), block.full_names(at[known]))
    return _Candidates(first, last, known, name, block.doc[first])


def _settled(runs: _Candidates, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The runs whose whole neighbourhood stands in a document with a smaller id."""
    own = ids[runs.doc[runs.known]]
    asked, least = _distinct(runs.name[runs.known], own)
    out = np.zeros(len(runs.first), bool)
    if len(asked):
        k = np.searchsorted(asked, runs.name[runs.known])
        out[runs.known] = _bits(answers, 2)[k] | (own > least[k])
    return out


def _ask_seeds(length: int, ranges: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                _, block = _open(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), length)
                if rows := list(_ask(batch.column(0)[k].as_py(), _seeds(block)[0], None, ranges)):
                    yield _rows(rows)

    return run


def _answer(stage: int, rows: pa.Table) -> pa.Table:
    """For one range of names, sorted over all blocks. Stage 1: which stand in another block too.
    Later: which stand in another block's document with a smaller id than the block's own least."""
    k, blocks = rows["k"][0].as_py(), rows["block"]
    lists = [_unpack_sorted(x) for x in rows["names"].to_pylist()]
    names, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
    order = np.argsort(names, kind="stable")
    names = names[order]
    first = np.concatenate([[True], names[1:] != names[:-1]])
    flags = np.zeros(len(names), bool)
    if stage == 1:
        flags[order] = ~first | ~np.append(first[1:], True)
    else:
        ids = np.concatenate([_unpack(x, np.int64) for x in rows["ids"].to_pylist()])[order]
        edge = np.flatnonzero(first)
        flags[order] = ids > np.repeat(np.minimum.reduceat(ids, edge), np.diff(np.append(edge, len(ids))))
    bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]
    n = len(sizes)
    return pa.table({"block": blocks, "stage": pa.array([stage] * n, pa.int32()), "k": pa.array([k] * n, pa.int32()), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})


_ANSWER = "block long, stage int, k int, n int, bits binary"


def _ask_names(stage: int, length: int, ranges: int, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Stage 2 asks for neighbourhoods, stage 3 for the strings of the runs that these left open."""
    out = []
    for row in blocks.to_pylist():
        docs, block = _open(row["head"], row["data"], length)
        runs, ids = _candidates(block, answers), docs.column(0).to_numpy()
        if stage == 2:
            names, least = _distinct(runs.name[runs.known], ids[runs.doc[runs.known]])
        else:
            at = runs.strings(~_settled(runs, ids, answers))
            names, least = _distinct(block.full_names(at), ids[block.doc[at]])
        out += _ask(row["block"], names, least, ranges)
    return pa.Table.from_batches([_rows(out)]) if out else pa.table({"k": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "names": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _remove(length: int, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    ids, sizes, spans, kept = [], [], [], []
    for row in blocks.to_pylist():
        docs, block = _open(row["head"], row["data"], length)
        runs, known = _candidates(block, answers), docs.column(0).to_numpy()
        settled = _settled(runs, known, answers)
        at = runs.strings(~settled)
        own, names = known[block.doc[at]], block.full_names(at)
        asked, least = _distinct(names, own)
        k = np.searchsorted(asked, names)
        marked = runs.strings(settled)
        if len(at):
            marked = np.concatenate([marked, at[_bits(answers, 3)[k] | (own > least[k])]])
        edge = np.bincount(marked, minlength=len(block.data) + 1) - np.bincount(marked + length, minlength=len(block.data) + 1)
        gone = np.cumsum(edge[:-1]) > 0
        for i, (a, b) in enumerate(zip(block.off[:-1], block.off[1:], strict=True)):
            starts, ends = _runs(gone[a:b])
            ids.append(None if docs.column(2)[i].as_py() else docs.column(0)[i].as_py())
            sizes.append(int(b - a))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends, strict=True)])
            kept.append(block.data[a:b][~gone[a:b]].tobytes())
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "removed": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, names_per_range: int = 1 << 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_bytes, removed, kept) of every row: ``removed`` are the maximal runs of UTF-8 bytes
    that a string of ``length`` bytes covers which also starts in a document with a smaller id,
    ``kept`` the bytes left, end to end.

    Strings are judged on the input; matches never cross rows. Null and empty text have no bytes
    and lose none. Rows that share an id are one document in order and take nothing from each
    other; rows without an id come last and take nothing from each other. A text longer than a
    block is a block of its own. An empty table gives an empty one."""
    if length < SEED:
        raise ValueError(f"length must be {SEED} at least")
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(1, n_bytes // (4 * names_per_range))
    whole = blocks.select("block", "head", "data")
    asks = whole.mapInArrow(_ask_seeds(length, max(1, ranges // 4)), _ASK)
    first = C.cut(asks.groupBy("k").applyInArrow(_answering(1), _ANSWER), "suffix-answers")
    answers = first
    for stage in (2, 3):
        asks = whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_asking(stage, length, ranges), _ASK)
        answers = answers.unionByName(C.cut(asks.groupBy("k").applyInArrow(_answering(stage), _ANSWER), "suffix-answers"))
    return whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda rows, got: _remove(length, rows, got), "id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")


def _asking(stage: int, length: int, ranges: int):
    return lambda rows, answers: _ask_names(stage, length, ranges, rows, answers)


def _answering(stage: int):
    return lambda rows: _answer(stage, rows)
