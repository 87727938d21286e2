"""Byte-level BPE by a global shuffle of distinct words, and its inverse.

Where the rows are read, texts are split into pre-tokens and each pre-token becomes a code at
its position, in a table of blocks of documents that is written once, bucketed by block, and
stays where it is. Codes below the size of a small hot table stand for the most frequent words,
chosen from a bounded sample, whose rows would pile up; any other word is sent once for each
block that has it. These words are shuffled by ranges of their hash, every distinct word is
encoded once where its rows meet, and the ids go back to the blocks, where texts are reassembled
by position. Decoding looks ids up in the token-byte table, whose size the vocabulary fixes.

What the hot table holds changes no result, only how many words take the way of the shuffle.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import common as C

#: Unicode White_Space, which is what \\s means in the pattern's own dialect.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Code points below this have their classes spelled out for Python's faster engine.
_FAST_BELOW = 0x2000
#: Bytes of text that make a block.
BLOCK_BYTES = 4 << 20
#: Words (one for each block that has it) that meet in one group, and blocks whose words may.
WORDS_PER_GROUP, BLOCKS_PER_GROUP = 400_000, 50_000


def _class(letter: str) -> str:
    """A character class's inside: the code points below _FAST_BELOW of a general category."""
    flags = np.array([unicodedata.category(chr(c))[0] == letter for c in range(_FAST_BELOW)] + [False])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags]).astype(np.int8)))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


@cache
def _splitters(pattern: str):
    """``pattern`` for texts of any characters, and for texts below _FAST_BELOW or None if it uses more than \\p{L}, \\p{N} and \\s."""
    spaced = pattern.replace("(?!\\S)", f"(?![^{_WHITE}])").replace("[^\\s", f"[^{_WHITE}").replace("\\s", f"[{_WHITE}]")
    letters, numbers = _class("L"), _class("N")
    parts = regex.split(r"(\[[^\]]*\])", spaced)  # inside brackets a class needs none of its own
    fast = "".join(p.replace("\\p{L}", letters).replace("\\p{N}", numbers) if p[:1] == "[" else p.replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{numbers}]") for p in parts)
    return regex.compile(spaced), None if "\\p" in fast or "\\S" in fast else re.compile(fast)


_BEYOND = regex.compile(f"[^\\u0000-\\u{_FAST_BELOW - 1:04x}]")


def split(text: str, pattern: str) -> list[str]:
    full, fast = _splitters(pattern)
    return full.findall(text) if fast is None or not text.isascii() and _BEYOND.search(text) else fast.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Tokenizer:
    """Ranks and pattern of a byte-level BPE, with the encoder built once in each process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self._encoder = ranks, pattern, None

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_encoder": None}

    def encode_word(self, word: str) -> list[int]:
        if self._encoder is None:
            import tiktoken

            self._encoder = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        return self._encoder.encode_ordinary(word)


def hot_words(docs: DataFrame, text_col: str, pattern: str, size: int, sample_docs: int) -> list[str]:
    """The ``size`` most frequent words of about ``sample_docs`` documents, by a hash of the text."""
    n = docs.count()
    few = docs.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    if n > sample_docs:
        few = few.where(F.pmod(F.xxhash64("t", F.lit("hot")), F.lit(1_000_003)) < 1_000_003 * sample_docs / n)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            found.update(split(text, pattern))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

    top = C.map_batches(few, count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(size)
    return top.toArrow()["w"].to_pylist()


def _planes(codes: np.ndarray) -> bytes:
    """Codes as four byte planes, compressed: frequent words have small codes."""
    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unplanes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack_words(words: list[str]) -> tuple[bytes, bytes]:
    """Lengths in bytes and the bytes, compressed."""
    raw, off = C.text_bytes(pa.array(words, pa.string()))
    return _planes(np.diff(off)), zstandard.compress(raw.tobytes(), 3)


def _unpack_words(lengths: bytes, data: bytes) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(_unplanes(lengths))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(zstandard.decompress(data))])


def _hashes(words: pa.Array) -> np.ndarray:
    raw, off = C.text_bytes(words)
    return C.span_hashes(raw, off[:-1], off[1:])


def _explode(held, at: int, rest: list[int]):
    """Blocks (block, codes, carried, n_tail, lengths, words): the words of a block that aren't hot
    stand in the order of their hashes, and a word's code is its place there after the hot ones."""

    def run(batches):
        from pyspark import TaskContext

        tok, words, *_ = held.value
        table, key = {w: i for i, w in enumerate(words)}, TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece, _ in C.pieces(batch, batch.column(at), BLOCK_BYTES) if batch.num_rows else ():
                local: dict[str, int] = {}
                codes, counts = [], []
                for text in piece.column(at).to_pylist():
                    own = split(text, tok.pattern) if text else []
                    counts.append(len(own))
                    codes.append(np.fromiter((table[w] if w in table else len(words) + local.setdefault(w, len(local)) for w in own), np.int64, len(own)))
                tail = pa.array(list(local), pa.string())
                order = np.argsort(_hashes(tail), kind="stable")
                place = np.empty(len(words) + len(tail), np.int64)
                place[: len(words)] = np.arange(len(words))
                place[len(words) + order] = len(words) + np.arange(len(tail))
                flat = place[np.concatenate(codes)] if codes else place[:0]
                cols = [piece.column(i) for i in rest]
                carried = pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [str(i) for i in range(len(cols) + 1)])
                lengths, data = _pack_words(tail.take(pa.array(order)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([_planes(flat)], pa.binary()), pa.array([_ipc(carried)], pa.binary()), pa.array([len(tail)]), pa.array([lengths], pa.binary()), pa.array([data], pa.binary())],
                    ["block", "codes", "carried", "n_tail", "lengths", "words"],
                )
                key += 1

    return run


def _ask(ranges: int, salts: int):
    """Rows (k, salt, block, lengths, words): a block's words cut by ranges of their hash."""

    def run(batches):
        edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                words = _unpack_words(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                cuts = [0, *np.searchsorted(_hashes(words), edges).tolist(), len(words)]
                some = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if not some:
                    continue
                block = batch.column(0)[i].as_py()
                packed = [_pack_words(words.slice(a, b - a).to_pylist()) for _, a, b in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in some], pa.int32()), pa.array([(block ^ (block >> 32)) % salts] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())],
                    ["k", "salt", "block", "lengths", "words"],
                )

    return run


def _encode_words(held):
    """For one range of words: each distinct one is encoded once, the ids go to every block that asked."""

    def run(rows: pa.Table) -> pa.Table:
        tok = held.value[0]
        known: dict[str, list[int]] = {}
        sizes, ids = [], []
        for lengths, data in zip(rows["lengths"].to_pylist(), rows["words"].to_pylist(), strict=True):
            own = []
            for w in _unpack_words(lengths, data).to_pylist():
                if (x := known.get(w)) is None:
                    x = known[w] = tok.encode_word(w)
                own.append(x)
            sizes.append(_planes(np.array([len(x) for x in own])))
            ids.append(_planes(np.array([i for x in own for i in x])))
        return pa.table({"block": rows["block"], "k": rows["k"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return run


def _reassemble(held, at: int, names: list[str]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, hot_off, hot_flat = held.value
        answers = answers.sort_by("k")
        sizes = [_unplanes(x) for x in answers["sizes"].to_pylist()]
        size = np.concatenate([np.diff(hot_off), *sizes]).astype(np.int64)
        flat = np.concatenate([hot_flat, *(_unplanes(x) for x in answers["ids"].to_pylist())]).astype(np.int32)
        start = np.cumsum(size) - size
        codes = _unplanes(blocks["codes"][0].as_py())
        many = size[codes]
        ends = np.cumsum(many)
        ids = flat[np.repeat(start[codes] - (ends - many), many) + np.arange(ends[-1])] if len(codes) else flat[:0]
        carried = pa.ipc.open_stream(blocks["carried"][0].as_py()).read_all().combine_chunks()
        words_in = np.cumsum(carried.column(carried.num_columns - 1).to_numpy())
        off = np.concatenate([[0], np.concatenate([[0], ends])[words_in]]).astype(np.int32)
        cols = [carried.column(i) for i in range(carried.num_columns - 1)]
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
        cols.insert(at, pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32())))
        return pa.table(cols, names=names)

    return run


def encode(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", ids_col: str = "ids", hot: int = 1 << 13, sample_docs: int = 1 << 12) -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``ids_col``, array<int>, in its place.

    Each match of the pattern is encoded by itself, without special tokens. Null and empty text
    give an empty array; texts are encoded whole; rows that repeat stay apart; an empty table
    gives an empty one. Other columns are carried along, but for one that has the name ``ids_col``."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c == ids_col and c != text_col])
    words = hot_words(docs, text_col, tokenizer.pattern, hot, sample_docs)
    ids = [tokenizer.encode_word(w) for w in words]
    held = spark.sparkContext.broadcast((tokenizer, words, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.array([i for x in ids for i in x], np.int32)))
    at, rest = docs.columns.index(text_col), [i for i, c in enumerate(docs.columns) if c != text_col]
    schema = "block long, codes binary, carried binary, n_tail long, lengths binary, words binary"
    blocks = C.bucketed(docs, text_col, lambda d: d.mapInArrow(_explode(held, at, rest), schema), "block", "bpe-blocks")
    total = blocks.agg(F.sum("n_tail").alias("words"), F.count("*").alias("blocks")).first()
    salts = max(1, -(-total["blocks"] // BLOCKS_PER_GROUP))
    ranges = max(1, -(-(total["words"] or 0) // (salts * WORDS_PER_GROUP)))
    asked = blocks.where("n_tail > 0").select("block", "lengths", "words").mapInArrow(_ask(ranges, salts), "k int, salt int, block long, lengths binary, words binary")
    answers = asked.groupBy("k", "salt").applyInArrow(_encode_words(held), "block long, k int, sizes binary, ids binary")
    fields = StructType([StructField(ids_col, ArrayType(IntegerType())) if i == at else f for i, f in enumerate(docs.schema)])
    return blocks.select("block", "codes", "carried").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reassemble(held, at, fields.names), fields)


def decode(df: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``: the bytes that ``ids_col`` stands for. Null ids give empty bytes;
    an id that is not in the table is an error."""
    tokens = [b""] * (max(tokenizer.ranks.values(), default=-1) + 1)
    for token, rank in tokenizer.ranks.items():
        tokens[rank] = token
    held = df.sparkSession.sparkContext.broadcast((np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), np.frombuffer(b"".join(tokens), np.uint8)))
    df = df.drop(*[c for c in df.columns if c == bytes_col])
    C.small_batches(df.sparkSession)
    at = df.columns.index(ids_col)
    schema = StructType([*df.schema.fields, StructField(bytes_col, BinaryType())])

    def run(batches):
        off, data = held.value
        size = np.diff(off)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                lists = batch.column(at)
                lists = lists.fill_null([]) if lists.null_count else lists
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                n = size[ids]
                ends = np.concatenate([[0], np.cumsum(n)])
                out = data[np.repeat(off[ids] - ends[:-1], n) + np.arange(ends[-1])] if len(ids) else np.zeros(0, np.uint8)
                bounds = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, bytes_col])

    return df.mapInArrow(run, schema)


def public_tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> Tokenizer:
    import public_tokenizers

    return Tokenizer(read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)
