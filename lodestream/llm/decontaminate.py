"""Benchmark decontamination with suffix arrays over the training text.

Each shard (a slice of the corpus of bounded size, made where the rows are read) builds a
suffix array over its word sequence, and every suffix of every test item is looked up in it by
binary search. Words are coded by the test vocabulary; a training suffix that opens with no
word of it can match nothing and stays out of the array (a sparse suffix array; no match is
lost). The range of equal keys gives every place where a whole window stands, and places whose windows follow each
other make up the longest verbatim matches (``longest_matches`` has them with their locations). Nothing is shuffled; the test
set goes out in blocks of at most ``block_words`` words, one pass over the texts for each block,
so that what is broadcast has a bound however large the test set is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

#: Words are runs of ASCII letters, digits and any byte above 0x7F, A-Z lower-cased.
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word fingerprints, first word of each row with the total at the end, bounds as (n, 2) bytes)."""
    raw, off = C.text_bytes(column)
    low = C.LOWER[raw]
    starts, ends, first = C.word_spans(_WORD[low], off)
    return C.span_hashes(low, starts, ends), first, np.stack([starts, ends], 1)


@dataclass
class TestBlock:
    """Windows of some test items: ``keys`` sorted, one for each distinct window of ``window``
    words or each whole item of fewer, padded with 0."""

    vocabulary: np.ndarray  # sorted word fingerprints; code k + 1 is vocabulary[k]
    keys: np.ndarray  # (n, window) codes of the distinct windows, sorted
    sizes: np.ndarray  # words in each window
    items: list  # for each window, positions in ids
    ids: list
    places: np.ndarray  # (n, 3): window, position in ids, first word in the item; sorted by window


def _block(ids: list, texts: list, window: int) -> TestBlock:
    hashes, first, _ = words_of(pa.array(texts, pa.string()))
    vocabulary = np.unique(hashes)
    codes = np.searchsorted(vocabulary, hashes).astype(np.uint32) + 1
    found: dict[bytes, list[tuple[int, int]]] = {}
    for i in range(len(ids)):
        own = codes[first[i] : first[i + 1]]
        for at in range(max(1, len(own) - window + 1) if len(own) else 0):
            found.setdefault(_padded(own[at : at + window], window), []).append((i, at))
    order = sorted(found)
    keys = np.frombuffer(b"".join(order), ">u4").reshape(-1, window)
    places = np.array([(k, i, at) for k, key in enumerate(order) for i, at in found[key]], np.int64).reshape(-1, 3)
    return TestBlock(vocabulary, keys.astype(np.uint32), (keys > 0).sum(1), [sorted({i for i, _ in found[k]}) for k in order], ids, places)


def _padded(codes: np.ndarray, window: int) -> bytes:
    out = np.zeros(window, ">u4")
    out[: len(codes)] = codes
    return out.tobytes()


def _sorted_suffixes(codes: np.ndarray, ends: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the positions ``at``: (keys of ``window`` codes cut at the row's end, positions)."""
    steps = at[:, None] + np.arange(window)
    keys = np.where(steps < ends[:, None], codes[np.minimum(steps, len(codes) - 1)], 0)
    order = np.lexsort(keys.T[::-1])
    return keys[order], at[order]


def _ranges(keys: np.ndarray, tests: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each test suffix in the suffix array: for its ``sizes`` first words, the
    range of suffixes that open with them. All searches advance together."""

    def search(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(keys), np.int64)
        cols = np.arange(keys.shape[1])
        inside = cols < sizes[:, None]
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            k = keys[np.minimum(mid, len(keys) - 1)]
            differ = (k != tests) & inside
            at = differ.argmax(1)
            rows = np.arange(len(tests))
            less = np.where(differ.any(1), k[rows, at] < tests[rows, at], right)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    return search(False), search(True)


def shard_matches(column, block: TestBlock):
    """(n words of each row, first words, places where a window stands, window of each place)."""
    hashes, first, bounds = words_of(column)
    n, window = len(hashes), block.keys.shape[1]
    none = np.zeros(0, np.int64)
    if not n or not len(block.keys):
        return first, bounds, none, none
    found = np.searchsorted(block.vocabulary, hashes)
    found[found == len(block.vocabulary)] = 0
    codes = np.where(block.vocabulary[found] == hashes, found + 1, 0).astype(np.uint32)
    # Suffixes that could match: their first two words open a window (or one that is a whole item).
    ends = np.repeat(first[1:], np.diff(first))
    after = np.zeros(n, np.uint64)
    after[:-1] = codes[1:]
    after[np.arange(n) + 1 >= ends] = 0
    pair = (codes.astype(np.uint64) << np.uint64(32)) | after
    heads = (block.keys[:, 0].astype(np.uint64) << np.uint64(32)) | (block.keys[:, 1] if window > 1 else 0)
    alone = np.isin(codes, block.keys[block.sizes == 1, 0]) if (block.sizes == 1).any() else np.zeros(n, bool)
    at = np.flatnonzero((codes > 0) & (alone | (_member(pair, np.unique(heads)) if window > 1 else True)))
    if not len(at):
        return first, bounds, none, none
    keys, places = _sorted_suffixes(codes, ends[at], at, window)
    lo, hi = _ranges(keys, block.keys, block.sizes)
    many = hi - lo
    which = np.repeat(np.arange(len(many)), many)
    where = places[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    return first, bounds, where, which


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _row_hits(text: pa.Array, block: TestBlock) -> tuple[np.ndarray, dict[int, tuple[list[list[int]], list]]]:
    """(words of each row, for each row with a match: (merged ranges of hit words, sorted items))."""
    first, _, where, which = shard_matches(text, block)
    row = np.searchsorted(first, where, "right") - 1
    order = np.argsort(row, kind="stable")
    where, which, row = where[order], which[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(first)))
    found = {}
    for i in np.unique(row).tolist():
        a, b = bounds[i], bounds[i + 1]
        start = where[a:b] - first[i]
        found[i] = _merged(start, start + block.sizes[which[a:b]]), sorted({block.ids[k] for w in np.unique(which[a:b]) for k in block.items[w]})
    return np.diff(first), found


def _spans(found: list[list[list[int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _blocks(benchmark: DataFrame, block_words: int):
    """Bounded lists of (id, text), streamed; an item longer than a block is a block of its own."""
    ids, texts, words = [], [], 0
    for row in benchmark.where("t IS NOT NULL AND i IS NOT NULL").toLocalIterator():
        n = len(row["t"]) // 2 + 1
        if ids and words + n > block_words:
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(row["i"]), texts.append(row["t"])
        words += n
    yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 1 << 21) -> DataFrame:
    """``docs`` with ``__n_words``, ``__spans`` (hit words as [start, end) ranges, those that overlap
    or touch merged) and ``__items`` (ids of the items matched, sorted).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. Null or empty text has no words; items with null text or id match nothing; equal
    rows are judged alike; an empty table on either side gives no matches. Rows are kept as they
    are, with every column they have."""
    C.small_batches(docs.sparkSession)
    wide = pa.int64() if benchmark.schema[item_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    kind = "long" if wide == pa.int64() else "string"
    text = F.col(f"`{text_col}`")
    bench = benchmark.select(F.col(item_col).cast(kind).alias("i"), F.col(item_text_col).alias("t"))
    blocks = (_block(ids, texts, window) for ids, texts in _blocks(bench, block_words))
    send = docs.sparkSession.sparkContext.broadcast
    prints = [F.xxhash64(text).alias("p"), F.xxhash64(text, F.lit("second")).alias("q")]
    out = _first_pass(C.packed(docs, text.alias("t"), *prints), send(next(blocks)), wide, kind)
    # Each further block reads the texts alone and gives rows for those with a match, by two hashes of the text.
    more = [C.cut(_further_pass(docs.select(text.alias("t"), *prints), send(b), wide, kind), "decontaminate") for b in blocks]
    if more:
        found = more[0]
        for x in more[1:]:
            found = found.unionByName(x)
        found = C.cut(found.groupBy("p", "q").agg(F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2")), "decontaminate")
        found = F.broadcast(found) if found.count() <= MOST_SENT else found
        out = _both(out.join(found, ["p", "q"], "left"), wide)
    return C.unpacked(out, docs.columns, __n_words=F.col("n_words"), __spans=F.col("spans"), __items=F.col("items"))


#: Texts with matches in further blocks that are broadcast to be added to those of the first.
MOST_SENT = 100_000

_SPAN_TYPE = "array<struct<start:int,end:int>>"


def _first_pass(src: DataFrame, held, wide: pa.DataType, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, text in C.pieces(batch, batch.column(1)) if batch.num_rows else ():
                n_words, found = _row_hits(text, held.value)
                got = [found.get(i, ([], [])) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 2, 3)), pa.array(n_words, pa.int64()), _spans([x for x, _ in got]), pa.array([y for _, y in got], pa.list_(wide))], ["row", "p", "q", "n_words", "spans", "items"])

    made = StructType.fromDDL(f"n_words long, spans {_SPAN_TYPE}, items array<{kind}>")
    return src.mapInArrow(run, StructType([*(f for f in src.schema if f.name != "t"), *made]))


def _further_pass(src: DataFrame, held, wide: pa.DataType, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, text in C.pieces(batch, batch.column(0)) if batch.num_rows else ():
                _, found = _row_hits(text, held.value)
                rows = pa.array(list(found), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1).take(rows), part.column(2).take(rows), _spans([x for x, _ in found.values()]), pa.array([y for _, y in found.values()], pa.list_(wide))], ["p", "q", "spans", "items"])

    return src.mapInArrow(run, f"p long, q long, spans {_SPAN_TYPE}, items array<{kind}>").dropDuplicates(["p", "q"])


def _both(df: DataFrame, wide: pa.DataType) -> DataFrame:
    """Rows with ``spans`` and ``items`` and, where not null, ``s2`` and ``i2`` to be added to them."""

    def run(batches):
        for batch in batches:
            spans = []
            for x, y in zip(batch.column("spans").to_pylist(), batch.column("s2").to_pylist(), strict=True):
                own = x + (y or [])
                spans.append(_merged(np.array([z["start"] for z in own], int), np.array([z["end"] for z in own], int)))
            items = [sorted({*x, *(y or [])}) for x, y in zip(batch.column("items").to_pylist(), batch.column("i2").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_words"), _spans(spans), pa.array(items, pa.list_(wide))], ["row", "n_words", "spans", "items"])

    src = df.select("row", "n_words", "spans", "items", "s2", "i2")
    return src.mapInArrow(run, StructType([f for f in src.schema if f.name not in ("s2", "i2")]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = 10) -> DataFrame:
    """``docs`` without those in which a window of a test item stands."""
    found = find_contamination(docs, benchmark, text_col, item_col, window=window)
    return found.where(F.size("__spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def _maximal(where: np.ndarray, which: np.ndarray, block: TestBlock) -> np.ndarray:
    """(item, first word in the item, first word here, words) of the matches that can't be longer, from
    the windows found in one row: places on one diagonal that follow each other are one match."""
    begin = np.searchsorted(block.places[:, 0], which)
    many = np.searchsorted(block.places[:, 0], which, "right") - begin
    at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
    q, item, pos, size = np.repeat(where, many), block.places[at, 1], block.places[at, 2], np.repeat(block.sizes[which], many)
    order = np.lexsort((q, q - pos, item))
    q, item, pos, size = q[order], item[order], pos[order], size[order]
    new = np.ones(len(q), bool)
    new[1:] = (item[1:] != item[:-1]) | (q[1:] - pos[1:] != q[:-1] - pos[:-1]) | (q[1:] != q[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(q)) - 1
    return np.stack([item[first], pos[first], q[first], q[last] + size[last] - q[first]], 1)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 1 << 21) -> DataFrame:
    """(id, item, item_start, start, n_words): every verbatim match of ``window`` words or more (or of a
    whole item of fewer) that can't be extended to either side, in words; one row for each place of
    an item and of a document. Rows without a match give none; null texts match nothing."""
    C.small_batches(docs.sparkSession)
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    bench = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"))
    out = None
    for ids, texts in _blocks(bench, block_words):
        held = docs.sparkSession.sparkContext.broadcast(_block(ids, texts, window))
        one = src.mapInArrow(_matching(held), f"id {kinds[0]}, item {kinds[1]}, item_start int, start int, n_words int")
        out = one if out is None else out.unionByName(one)
    return out


def _matching(held):
    def run(batches):
        block = held.value
        kind = pa.array(block.ids[:1]).type if block.ids else pa.int64()
        for batch in batches:
            for part, text in C.pieces(batch, batch.column(1)) if batch.num_rows else ():
                first, _, where, which = shard_matches(text, block)
                row = np.searchsorted(first, where, "right") - 1
                for i in np.unique(row):
                    own = row == i
                    m = _maximal(where[own] - first[i], which[own], block)
                    ids = pa.array([block.ids[k] for k in m[:, 0]], kind)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i] * len(m))), ids, *(pa.array(m[:, k], pa.int32()) for k in (1, 2, 3))], ["id", "item", "item_start", "start", "n_words"])

    return run
