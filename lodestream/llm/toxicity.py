"""Toxicity by class-conditional Kneser-Ney models over words.

Two word models, of toxic and of ordinary text. A class's counts are Kneser-Ney continuation
counts: in how many different contexts (words before it) a word stands in the class's texts, so
that a word repeated a thousand times in one place counts little. They are discounted by
amounts estimated from counts of counts (1, 2, 3 and more), and what that frees goes to backoff
counts that both classes share, which go to a uniform distribution over the vocabulary and one
unseen word in turn; a rare expression is thus smoothed alike in both classes. All counts cover
every labelled row and stay a Spark table, which grows with the labelled text.

A text is read as the mean log-likelihood ratio of its words (the difference of the two
length-normalised log-likelihoods) and the likelihood ratios of its three strongest distinct
words, so that a few toxic words in a long document aren't drowned. A logistic model of these, and of
the length, is fitted to rows that each half of the labelled ones gets from the other half's
counts. The table of ratios is broadcast if counted small, else joined by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Most distinct words whose ratios are broadcast (20 bytes each).
BROADCAST_WORDS = 4_000_000
#: Labelled rows that the logistic model is fitted to, about.
FIT_ROWS = 20_000
TOP = 3
#: Log-ratios of single words are read up to this.
MOST_RATIO = 8.0

#: Words are runs of ASCII letters, digits and any byte above 0x7F, A-Z lower-cased.
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(word fingerprints, first word of each row with the total at the end)."""
    raw, off = C.text_bytes(column)
    low = C.LOWER[raw]
    starts, ends, first = C.word_spans(_WORD[low], off)
    return C.span_hashes(low, starts, ends).view(np.int64), first


@dataclass
class Model:
    """``ratios`` (h, r0, r1, r2): log-ratio of each word by the counts of half 0, half 1 and both,
    less that of an unseen word; the logistic model's weights (features, then the offset)."""

    ratios: DataFrame | None
    n_words: int
    weights: np.ndarray


def contexts(labelled: DataFrame) -> DataFrame:
    """(h, c0 to c5): of each word, the distinct contexts in ordinary and in toxic texts, each by
    half 0, half 1, both. ``labelled`` has (k, t): class + class + half, and the text."""

    def run(batches):
        for batch in batches:
            for part, text in C.pieces(batch, batch.column(1)) if batch.num_rows else ():
                h, first = words_of(text)
                before = np.zeros(len(h), np.uint64)
                before[1:] = h[:-1].view(np.uint64)
                before[first[:-1][np.diff(first) > 0]] = 0
                k = np.repeat(part.column(0).to_numpy(), np.diff(first)).astype(np.int64)
                pair = C.mix(before * np.uint64(0x9FB21C651E98DF25) + h.view(np.uint64)).view(np.int64)
                order = np.lexsort((k, pair, h))
                h, pair, k = h[order], pair[order], k[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (pair[1:] != pair[:-1]) | (k[1:] != k[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(pair[new]), pa.array((1 << k[new]).astype(np.int32))], ["h", "b", "bits"])

    seen = labelled.mapInArrow(run, "h long, b long, bits int").groupBy("h", "b").agg(F.bit_or("bits").alias("bits"))
    has = lambda mask: F.sum((F.col("bits").bitwiseAND(mask) != 0).cast("long"))
    return seen.groupBy("h").agg(*[has(mask).alias(f"c{k}") for k, mask in enumerate((1, 2, 3, 4, 8, 12))])


def discounts(counts_of_counts: list[int]) -> list[float]:
    """What is taken from counts of 1, 2, and 3 and more, from the numbers of words that have 1 to 4."""
    n1, n2, n3, n4 = (max(n, 1) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.1), k + 0.999) for k, d in enumerate(raw)]


def log_ratios(table: DataFrame) -> tuple[DataFrame, int]:
    """(h, r0, r1, r2) from ``contexts``' table, and its number of words."""
    kinds = {**{f"c{k}": F.col(f"c{k}") for k in range(6)}, **{f"s{m}": F.col(f"c{m}") + F.col(f"c{3 + m}") for m in range(3)}}
    wide = table.select("h", *[v.alias(k) for k, v in kinds.items()])
    sums = [F.count("*").alias("words")]
    for k in kinds:
        sums += [F.sum(k).alias(f"{k}_n"), F.count_if(F.col(k) >= 3).alias(f"{k}_3up"), *[F.count_if(F.col(k) == j).alias(f"{k}_{j}") for j in (1, 2, 3, 4)]]
    got = wide.agg(*sums).first()
    cut = {k: discounts([got[f"{k}_{j}"] for j in (1, 2, 3, 4)]) for k in kinds}
    total = {k: max(got[f"{k}_n"] or 0, 1) for k in kinds}
    freed = {k: (cut[k][0] * got[f"{k}_1"] + cut[k][1] * got[f"{k}_2"] + cut[k][2] * got[f"{k}_3up"]) / total[k] if got[f"{k}_n"] else 1.0 for k in kinds}

    def own(k: str) -> Column:
        d = cut[k]
        return (F.col(k) - F.when(F.col(k) == 0, 0.0).when(F.col(k) == 1, d[0]).when(F.col(k) == 2, d[1]).otherwise(d[2])) / total[k]

    out = []
    for m in range(3):
        shared = own(f"s{m}") + freed[f"s{m}"] / (got["words"] + 1)
        toxic, ordinary = (own(f"c{3 * y + m}") + freed[f"c{3 * y + m}"] * shared for y in (1, 0))
        unseen = float(np.log(freed[f"c{3 + m}"] / freed[f"c{m}"]))
        out.append((F.log(toxic / ordinary) - unseen).cast("float").alias(f"r{m}"))
    return wide.select("h", *out), got["words"]


def _pooled(h: np.ndarray, first: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """(rows, 1 + TOP + 1): mean log-ratio, ratios of the strongest distinct words (less 1), log length."""
    rows = len(first) - 1
    n = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
    out = np.zeros((rows, TOP + 2))
    out[:, 0] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
    out[:, -1] = np.log1p(n)
    row = np.repeat(np.arange(rows), n)
    strong = np.flatnonzero(ratios > 0)
    row, h, ratios = row[strong], h[strong], ratios[strong]
    order = np.lexsort((h, -ratios, row))
    row, h, ratios = row[order], h[order], ratios[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, ratios = row[new], ratios[new]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    some = place < TOP
    out[row[some], 1 + place[some]] = np.expm1(np.minimum(ratios[some].astype(np.float64), MOST_RATIO))
    return out


def features(docs: DataFrame, text_col: str, model: Model, half: Column | None = None) -> DataFrame:
    """``docs`` with ``__x``, array<double>: what the logistic model reads. ``half`` (0 or 1) is the
    half whose counts judge a row, null or absent for both halves' counts."""
    which = F.coalesce(half, F.lit(2)) if half is not None else F.lit(2)
    src = C.packed(docs, which.cast("int").alias("m"), F.col(f"`{text_col}`").alias("t"))
    C.small_batches(docs.sparkSession)
    if model.n_words <= BROADCAST_WORDS:
        table = model.ratios.toArrow()
        keys = table["h"].to_numpy()
        order = np.argsort(keys)
        held = docs.sparkSession.sparkContext.broadcast((keys[order], np.stack([table[f"r{m}"].to_numpy()[order] for m in range(3)], 1) if len(keys) else np.zeros((0, 3), np.float32)))

        def run(batches):
            keys, ratios = held.value
            for batch in batches:
                for part, text in C.pieces(batch, batch.column(2)) if batch.num_rows else ():
                    h, first = words_of(text)
                    x = np.zeros(len(h), np.float32)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        known = keys[at] == h
                        x[known] = ratios[at[known], np.repeat(part.column(1).to_numpy(), np.diff(first))[known]]
                    pooled = _pooled(h, first, x)
                    yield pa.RecordBatch.from_arrays([part.column(0), C.list_array(pooled.ravel(), np.full(len(pooled), TOP + 2), pa.float64())], ["row", "x"])

        made = src.mapInArrow(run, src.select("row", F.array(F.lit(0.0)).alias("x")).schema)
        return C.unpacked(made, docs.columns, __x=F.col("x"))

    # Too many words to send to every task: each text's distinct words meet the table in a join. A
    # text is known by two hashes, so that copies of it are looked up once.
    prints = [F.xxhash64("t").alias("p"), F.xxhash64("t", F.lit("second")).alias("q")]
    texts = src.select("m", F.coalesce("t", F.lit("")).alias("t")).select("m", "t", *prints)

    def words(batches):
        for batch in batches:
            for part, text in C.pieces(batch, batch.column(1)) if batch.num_rows else ():
                h, first = words_of(text)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                take = pa.array(row[edge])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in (0, 2, 3)), pa.array(h[edge]), pa.array(np.diff(np.append(edge, len(h))))], ["m", "p", "q", "h", "n"])

    # Rows that repeat a text would count its words again: each text is taken once by its hashes.
    once = texts.groupBy("m", "p", "q").agg(F.any_value("t").alias("t")).select("m", "t", "p", "q")
    counted = once.mapInArrow(words, "m int, p long, q long, h long, n long").join(model.ratios, "h", "left")
    ratio = F.coalesce(F.when(F.col("m") == 0, F.col("r0")).when(F.col("m") == 1, F.col("r1")).otherwise(F.col("r2")), F.lit(0.0)).cast("double")
    strong = F.slice(F.sort_array(F.collect_list(F.when(F.col("r") > 0, F.expm1(F.least("r", F.lit(MOST_RATIO))))), False), 1, TOP)
    per = counted.withColumn("r", ratio).groupBy("m", "p", "q").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("mean"), strong.alias("top"))
    x = F.concat(F.array("mean"), F.slice(F.concat("top", F.array_repeat(F.lit(0.0), TOP)), 1, TOP), F.array(F.log1p("n")))
    zeros = F.array_repeat(F.lit(0.0), TOP + 2)
    keyed = src.select("row", "m", *[c.alias(f"_{k}") for k, c in enumerate(prints)])
    per = per.select(F.col("m").alias("pm"), "p", "q", x.alias("x"))
    made = keyed.join(per, (F.col("m") == F.col("pm")) & (F.col("_0") == F.col("p")) & (F.col("_1") == F.col("q")), "left")
    return C.unpacked(made, docs.columns, __x=F.coalesce("x", zeros))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a little weight decay: weights of the columns of x, then the offset."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        w += step * min(1, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def fit(labelled: DataFrame, text_col: str, label_col: str, half: str, fit_rows: int = FIT_ROWS) -> Model:
    """From every row with a label of 0 or 1; ``half`` is a boolean SQL expression that halves them.

    Null text is empty, null or other labels are left out. The logistic model is fitted to about
    ``fit_rows`` of the rows, by a hash of the text. Without rows of both classes the score is the
    share of toxic rows, smoothed, whatever the text."""
    rows = labelled.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{label_col}`").cast("int").alias("y"), F.coalesce(F.expr(half), F.lit(False)).cast("int").alias("half"), F.col(f"`{text_col}`").alias("t"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
        return Model(None, 0, np.append(np.zeros(TOP + 2), share))
    C.small_batches(labelled.sparkSession)
    ratios, n_words = log_ratios(C.cut(contexts(rows.select((2 * F.col("y") + F.col("half")).alias("k"), "t")), "toxicity-contexts"))
    model = Model(C.cut(ratios, "toxicity-ratios"), n_words, np.zeros(TOP + 3))
    if (n := sum(counts.values())) > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("t", F.lit("fit")), F.lit(1_000_003)) < 1_000_003 * fit_rows / n)
    got = features(rows, "t", model, 1 - F.col("half")).select("y", "__x").toArrow()
    x = np.array(got["__x"].to_pylist(), np.float64).reshape(-1, TOP + 2)
    model.weights = fit_logistic(x, got["y"].to_numpy().astype(np.float64)) if len(x) else model.weights
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__toxic`` (0 to 1). Null or empty text has no words and gets the score of no
    evidence; texts are read whole; repeated rows score alike; other columns stay, but for one
    with a result's name, which the result replaces."""
    w = model.weights
    if model.ratios is None:
        return C.unpacked(C.packed(docs), docs.columns, __toxic=F.lit(float(1 / (1 + np.exp(-w[-1])))))
    read = features(C.packed(docs, F.col(f"`{text_col}`").alias("t")), "t", model)
    z = sum((F.get("__x", F.lit(k)) * F.lit(float(w[k])) for k in range(TOP + 2)), F.lit(float(w[-1])))
    return C.unpacked(read, docs.columns, __toxic=F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z)))))
