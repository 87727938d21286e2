"""Near-duplicate groups by MinHash and an LSH forest.

Each distinct shingle set (documents with equal sets are one class from the start) has a long
MinHash signature, cut into ``trees`` keys of ``depth`` values. Every tree is the sorted order
of all classes by one key, so that classes whose keys share a prefix stand together: those that
share ``least`` leading values are a region. Candidates are longest-common-prefix neighbours: a
class meets the classes before it in its region, which are those that share the longest prefixes with
it, so that the depth adapts to how crowded the region is: ``near`` of them in a small region, two
and the region's first in a crowded one.
Candidates are confirmed on the full shingle sets, components are the least id reachable over
confirmed links, by rounds of joins over tables in the shared folder.

A pair whose ends other confirmed links already join need not be confirmed: it can't change a
component. So the likeliest candidate of each class is confirmed first, then the next ones, in
turns, of those that could still join two components.

A region of more than ``near`` + 1 classes (or one that goes on in the next partition) isn't
compared in full by that. Its class with most neighbours over all trees meets all others of it,
and where several components are left after this, every class outside the largest of them is
compared with every other on full sets, in tiles of bounded size that are dealt over tasks. So
no two classes of a region stay unmet unless they are in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: Classes before it that a class of a crowded region meets.
CLOSEST = 2
#: Classes on each side of a tile.
TILE = 1024


def shingle_sets(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle fingerprints of all rows, sorted within each; first of each row with the total at the end).

    A row with fewer words than ``words``, but some, has its whole sequence as its one shingle."""
    raw, off = C.text_bytes(column)
    low = C.LOWER[raw]
    starts, ends, first = C.word_spans(~_SPACE[low], off)
    h = C.span_hashes(low, starts, ends)
    n = np.diff(first)
    many = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    row = np.repeat(np.arange(len(n)), many)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    left = np.minimum(n[row], words)
    rolled = np.zeros(len(row), np.uint64)
    for k in range(words):
        inside = left > k
        rolled[inside] = C.mix(rolled[inside] * np.uint64(0x9FB21C651E98DF25) + h[at[inside] + k] + np.uint64(k))
    order = np.lexsort((rolled, row))
    row, rolled = row[order], rolled[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[keep], np.searchsorted(row[keep], np.arange(len(n) + 1))


def signatures(shingles: np.ndarray, first: np.ndarray, values: int, seed: int = 11) -> np.ndarray:
    """(rows, values) uint16: the low halves of minima over 32-bit permutations; rows without shingles are 0."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, values, dtype=np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, values), np.uint16)
    if len(some):
        short = (C.mix(shingles) >> np.uint64(32)).astype(np.uint32)
        for v in range(values):
            x = short * a[v]
            x ^= x >> np.uint32(15)
            x *= b[v] | np.uint32(1)
            out[some, v] = np.minimum.reduceat(x, first[some]).astype(np.uint16)
    return out


def _set_digest(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over a set's mixed shingles: equal sets have equal digests."""
    out = np.zeros((len(first) - 1, 2), np.int64)
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(C.mix(shingles + np.uint64(salt))))])
        out[:, k] = (total[first[1:]] - total[first[:-1]]).view(np.int64)
    return out


def _sketch(docs: DataFrame, words: int, values: int) -> DataFrame:
    """(id, digest d1 d2, n_shingles, signature) of every row; the text isn't carried."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, first = shingle_sets(batch.column(1), words)
        digest, sig = _set_digest(shingles, first), signatures(shingles, first, values)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.diff(first).astype(np.int64)), pa.array([s.tobytes() for s in sig.astype(">u2")], pa.binary())],
            ["id", "d1", "d2", "n_shingles", "sig"],
        )

    return C.map_batches(docs, run, "id long, d1 long, d2 long, n_shingles long, sig binary", most=1 << 20)


def _neighbours(classes: DataFrame, trees: int, depth: int, least: int, near: int, percent: int) -> DataFrame:
    """Rows (a, b, null, alone) are candidate pairs, a < b, as often as trees show them, ``alone`` (1)
    if their region is compared in full by them; rows (c, null, region, n) are the classes of the
    other regions, where a class only meets the ``CLOSEST`` before it and the region's first.

    Rows (tree, key, class) are range-partitioned by all three, which deals a crowded prefix over
    partitions, and sorted. Stretches of the stream are compared with the ``near`` rows before
    each row, all rows at once; sets too different in size are passed over."""
    spark = classes.sparkSession
    wide = 2 * depth
    cut_key = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.substring(F.col("sig"), k * wide + 1, F.lit(wide)))
    keys = classes.select("c", "n", F.posexplode(cut_key).alias("tree", "key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, "tree", "key", "c").sortWithinPartitions("tree", "key", "c").select("tree", "key", "c", "n")

    def compare(tree, key, c, n, head_c, head_n, fresh, open_first, open_last):
        """One stretch that begins with ``fresh`` rows that were compared before; the region that
        the first row stands in began with the row (head_c, head_n)."""
        same = (tree[1:] == tree[:-1]) & (key[1:, :least] == key[:-1, :least]).all(1)
        start = np.concatenate([[True], ~same])
        region = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(c)))
        part = size > near + 1
        part[0] |= open_first
        part[-1] |= open_last
        a, b, alone = [], [], []

        def meet(x, y, nx, ny, known):
            ok = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (x != y)
            a.append(np.minimum(x, y)[ok]), b.append(np.maximum(x, y)[ok]), alone.append(~known[ok])

        for k in range(1, min(near, len(c) - 1) + 1):
            at = np.arange(max(k, fresh), len(c))
            at = at[(region[at] == region[at - k]) & ((k <= CLOSEST) | ~part[region[at]])]
            meet(c[at], c[at - k], n[at], n[at - k], part[region[at]])
        fc, fn = c[first].copy(), n[first].copy()
        if head_c is not None:
            fc[0], fn[0] = head_c, head_n
        at = np.arange(fresh, len(c))
        at = at[(at - first[region[at]] > near) | ((region[at] == 0) & (head_c is not None))]
        meet(c[at], fc[region[at]], n[at], fn[region[at]], part[region[at]])
        told = np.flatnonzero(part[region] & (np.arange(len(c)) >= fresh))
        return np.concatenate(a), np.concatenate(b), np.concatenate(alone).astype(np.int64), told

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, head, fresh, begun = 0, (None, None), 0, False

        def settle(last: bool):
            nonlocal held, rows, head, fresh, begun
            t = pa.Table.from_batches(held).combine_chunks()
            tree, c, n = (t.column(k).to_numpy() for k in (0, 2, 3))
            key = C.text_bytes(t.column(1))[0].reshape(len(c), wide).view(">u2")
            a, b, alone, told = compare(tree, key, c, n, *head, fresh, not begun or head[0] is not None, True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.array(alone)], names)
            if len(told):
                hashed = C.mix(C.mix(np.ascontiguousarray(key[told, :least].astype(np.uint64)) @ weights) + tree[told].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(c[told]), pa.nulls(len(told), pa.int64()), pa.array(hashed.view(np.int64)), pa.array(n[told])], names)
            if not last:
                same = (tree == tree[-1]) & (key[:, :least] == key[-1, :least]).all(1)
                began = len(c) - int(same[::-1].argmin()) if not same.all() else 0
                if began or head[0] is None:
                    head = (c[began], n[began])
                keep = min(near, len(c) - began)
                held, rows, fresh, begun = t.slice(len(c) - keep).to_batches(), keep, keep, True

        names = ["a", "b", "region", "n"]
        weights = np.random.default_rng(3).integers(1, 1 << 62, least, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows - fresh >= 50_000:
                    yield from settle(False)
        if rows > fresh:
            yield from settle(True)

    return ordered.mapInArrow(run, "a long, b long, region long, n long")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on the full sets of both texts."""
    both = pairs.select("a", "b").join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for part, _ in C.pieces(batch, batch.column(3), 1 << 20) if batch.num_rows else ():
                sets = [shingle_sets(part.column(k), words) for k in (2, 3)]
                sizes = [np.diff(first) for _, first in sets]
                row = np.concatenate([np.repeat(np.arange(part.num_rows), s) for s in sizes])
                x = np.concatenate([s for s, _ in sets])
                order = np.lexsort((x, row))
                x, row = x[order], row[order]
                both_have = (x[1:] == x[:-1]) & (row[1:] == row[:-1])
                same = np.bincount(row[1:][both_have], minlength=part.num_rows)
                yield part.filter(pa.array(100 * same >= percent * (sizes[0] + sizes[1] - same))).select([0, 1])

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(c, component) of every end of the edges (a, b): the least id reachable.

    Rounds of taking the least label among neighbours and then the label's own label, ``rounds``
    of them from and to tables in the shared folder, until nothing changes; chains shrink by half
    a round. Minima are combined before they are shuffled; nothing is gathered in the driver."""
    many = 2 * edges.count()
    both = C.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges", many)
    labels = C.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "near-labels", many)
    while True:
        now = labels.select("a", F.col("l").alias("old"), "l")
        for _ in range(rounds):
            held = now.select("a", "l")
            near = both.join(held.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
            step = now.join(near, "a").select("a", "old", F.least("l", "m").alias("l"))
            now = step.join(held.select(F.col("a").alias("l"), F.col("l").alias("far")), "l").select("a", "old", F.least("l", "far").alias("l"))
        new = C.cut(now, "near-labels", many)
        labels = new.select("a", "l")
        if new.where("l <> old").isEmpty():
            return labels.select(F.col("a").alias("c"), F.col("l").alias("component"))


def _grown(joined: DataFrame | None, found: DataFrame) -> DataFrame:
    """(c, component) after more links: only the components that they join are labelled anew."""
    if joined is None:
        return components(found)
    at = lambda side: joined.select(F.col("c").alias(side), F.col("component").alias(f"c{side}"))
    over = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    top = components(C.cut(over, "near-edges", found.count())).select(F.col("c").alias("old"), F.col("component").alias("new"))
    moved = joined.join(top, joined["component"] == top["old"], "left").select("c", F.coalesce("new", "component").alias("component"))
    fresh = top.select(F.col("old").alias("c"), F.col("new").alias("component")).join(joined.select("c"), "c", "left_anti")
    return C.cut(moved.unionByName(fresh), "near-labels", joined.count() + 2 * found.count())


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes in different components."""
    at = lambda side: joined.select(F.col("c").alias(side), F.col("component").alias(f"c{side}"))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _labelled(members: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, c, n, l) of the regions with several components l, and for each of these regions
    (region, main, size, rest): its largest component, its classes, and those outside of it."""
    here = members.join(joined, "c", "left").select("region", "c", "n", F.coalesce("component", "c").alias("l"))
    parts = here.groupBy("region", "l").agg(F.count("*").alias("k"))
    info = parts.groupBy("region").agg(F.max(F.struct("k", "l")).alias("x"), F.sum("k").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    many = members.count()
    info = C.cut(info.select("region", F.col("x.l").alias("main"), "size", (F.col("size") - F.col("x.k")).alias("rest")), "near-regions", many)
    return C.cut(C.with_small(here, info.select("region"), "region"), "near-open", many), info


def _sets(src: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(c, set): sorted 64-bit shingles of the classes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, first = shingle_sets(batch.column(1), words)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["c", "set"])

    return C.map_batches(src.join(ids, "c", "left_semi").select("c", "text"), run, "c long, set binary", most=1 << 20)


def tile_links(c: np.ndarray, labels: np.ndarray, rows: np.ndarray, cols: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the classes ``rows`` and ``cols`` (places in the others) that join two
    components, as few as do: a pair whose ends are joined by then is passed over."""
    up = {int(x): int(x) for x in np.unique(labels)}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    flat = np.concatenate([sets[k] for k in cols])
    size = np.array([len(sets[k]) for k in cols])
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    vocabulary, code = np.unique(flat, return_inverse=True)
    has = np.zeros(len(vocabulary) + 1, np.int32)
    out = []
    for i in rows:
        own = np.searchsorted(vocabulary, sets[i])
        own = own[vocabulary[np.minimum(own, len(vocabulary) - 1)] == sets[i]]
        has[own] = 1
        same = np.add.reduceat(has[code], first)
        has[own] = 0
        for k in np.flatnonzero((100 * same >= percent * (len(sets[i]) + size - same)) & (labels[cols] != labels[i])):
            x, y = root(int(labels[i])), root(int(labels[cols[k]]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(min(c[i], c[cols[k]])), int(max(c[i], c[cols[k]]))))
    return out


def _tiles(open_: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a region: classes outside its largest component against
    all, a tile of at most about TILE by TILE classes a group, dealt by a hash of the class."""
    info = info.select("region", "main", F.ceil(F.col("rest") / TILE).alias("down"), F.ceil(F.col("size") / TILE).alias("across"))
    rows = C.with_small(open_, info, "region")
    down, across = F.pmod(F.xxhash64("c"), F.col("down")).alias("i"), F.pmod(F.xxhash64("c"), F.col("across")).alias("j")
    upright = rows.where("l <> main").select("region", "c", "l", down, F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("j"), F.lit(True).alias("row"))
    lying = rows.select("region", "c", "l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("i"), across, F.lit(False).alias("row"))
    dealt = upright.select("region", "i", "j", "row", "c", "l").unionByName(lying.select("region", "i", "j", "row", "c", "l")).join(sets, "c")

    def compare(t: pa.Table) -> pa.Table:
        c, l, row = (t.column(k).to_numpy() for k in ("c", "l", "row"))
        rows, cols = np.flatnonzero(row), np.flatnonzero(~row)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        found = tile_links(c, l, rows, cols, sets, percent) if len(rows) and len(cols) else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("region", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, trees: int = 28, depth: int = 8, least: int = 6, near: int = 8) -> DataFrame:
    """(id, n_shingles, component) of every row: the least id among documents that links reach.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct
    ``words``-word shingles, or the whole sequence of a text with fewer words. Documents link if
    100 * intersection >= percent * union. Rows without words (null and empty text) link with
    nothing and are their own component; so are rows without an id (component null). Equal texts
    are one class before any comparison, so that thousands of copies cost one; a row that repeats
    an id falls to the least component that any of them reaches; an empty table gives an empty one.
    Ids are whole numbers; another type is an error. A pair at the least similarity is in one
    region of a tree with probability 0.8^least, 0.26: all 28 trees miss it once in 5,000 times,
    and then only if no other link joins its ends. Within a region no pair is missed."""
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be of a whole-number type")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = C.cut(_sketch(src, words, trees * depth), "near-sketch", docs.count(), 2000)
    classes = sketch.where("n_shingles > 0 AND id IS NOT NULL").groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("id").alias("c"), F.first("sig").alias("sig"))
    classes = C.cut(classes, "near-classes", sketch.count(), 4000)
    met = C.cut(_neighbours(classes.select("c", "n", "sig"), trees, depth, least, near, percent), "near-neighbours", trees * classes.count(), 50_000)
    found = met.where("region IS NULL")
    pairs = C.cut(found.groupBy("a", "b").agg(F.count("*").alias("trees"), F.max("n").alias("alone")), "near-pairs", found.count(), 50_000)
    members = met.where("region IS NOT NULL").select("region", F.col("a").alias("c"), "n").distinct()
    sizes = members.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    members = C.cut(members.join(sizes, "region"), "near-members", met.where("region IS NOT NULL").count(), 50_000)
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).unionByName(members.select("c")).distinct()
    ends = C.cut(ends, "near-ends", classes.count(), 50_000)
    texts = C.cut(C.with_small(src.withColumnRenamed("id", "c"), ends, "c").groupBy("c").agg(F.min("text").alias("text")), "near-texts", ends.count(), 2000)

    # A class's candidates in the order of their likelihood: the next ones are confirmed while they could
    # join components. What is left of crowded regions' after two turns is left to the tiles.
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("trees"), "a"))
    ranked = C.cut(pairs.withColumn("rank", rank).where("rank <= 8 OR alone = 1").select("a", "b", "rank"), "near-ranked", pairs.count(), 50_000)
    joined = None
    for first, last in ((1, 1), (2, 8), (9, 64), (65, None)):
        turn = ranked.where(F.col("rank") >= first if last is None else F.col("rank").between(first, last)).select("a", "b")
        turn = C.cut(turn if joined is None else _apart(turn, joined), "near-turn", turn.count(), 50_000)
        if turn.isEmpty() and joined is not None:
            continue
        found = C.cut(_confirm(turn, texts, words, percent), "near-links", turn.count(), 1000)
        if joined is None or not found.isEmpty():
            joined = _grown(joined, found)
    open_, info = _labelled(members.select("region", "c", "n"), joined)
    top = C.cut(_tops(open_, members, percent).join(ranked, ["a", "b"], "left_anti"), "near-turn", open_.count())
    found = C.cut(_confirm(top, texts, words, percent), "near-links", open_.count(), 1000)
    if not found.isEmpty():
        joined = _grown(joined, found)
        open_, info = _labelled(open_.select("region", "c", "n"), joined)
    if not info.isEmpty():
        held = open_.select("c").distinct()
        sets = C.cut(_sets(texts, held, words), "near-sets", held.count(), 2000)
        more = C.cut(_tiles(open_, info, sets, percent), "near-links", open_.count(), 1000)
        if not more.isEmpty():
            joined = _grown(joined, more)
    roots = classes.select("d1", "d2", "n", "c").join(joined, "c", "left").select("d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("component", "c").alias("component"))
    out = sketch.select("id", "d1", "d2", "n_shingles").join(roots, ["d1", "d2", "n_shingles"], "left")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def _tops(open_: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the class of each open region with most neighbours over all trees (in a star, its
    centre) with every class of the region in another component."""
    degree = members.join(open_.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.sum(F.col("size") - 1).alias("degree"))
    ranked = open_.join(degree, "c")
    heads = ranked.groupBy("region").agg(F.max(F.struct("degree", (-F.col("c")).alias("h"), F.col("n").alias("hn"), F.col("l").alias("hl"))).alias("x")).select("region", (-F.col("x.h")).alias("h"), "x.hn", "x.hl")
    met = C.with_small(open_, C.cut(heads, "near-heads", open_.count()), "region").where(f"l <> hl AND 100 * least(n, hn) >= {percent} * greatest(n, hn)")
    return met.select(F.least("c", "h").alias("a"), F.greatest("c", "h").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the least id.

    Of rows that repeat an id the one with the least text stays (null texts last); rows without an
    id all stay; other columns are kept."""
    found = near_duplicates(docs, id_col, text_col, words, percent)
    stay = found.groupBy("id").agg(F.min("component").alias("least")).where("id = least").select(F.col("id").alias("__id"))
    src = C.packed(docs, F.col(f"`{id_col}`").alias("own"), F.col(f"`{text_col}`").alias("text"))
    first = src.join(stay, F.col("own") == F.col("__id")).groupBy("own").agg(F.coalesce(F.min_by("row", "text"), F.any_value("row")).alias("row"))
    return C.unpacked(first.select("row").unionByName(src.where("own IS NULL").select("row")), docs.columns)
