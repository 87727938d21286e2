"""Quality rules by repetition coverage.

For each document, rolling hashes of word n-grams of several lengths say which n-grams stand
twice or more in it, and the characters inside them are counted once each: the coverage of a
length is their share of the document's word characters. The same is measured for repeated
lines. A document whose coverage passes the limit of any length is rejected. All of it is
numpy over slices of bounded size, row by row independent: there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: Most of a document's word characters that repeated n-grams of a length may cover.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most that repeated lines may cover.
LINE_LIMIT = 0.30


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: (row, key) stands twice or more; it stood before."""
    order = np.lexsort((key, row)) if len(key) else np.zeros(0, np.int64)
    r, k = row[order], key[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    twice, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again = np.concatenate([[False], same])
    before[order] = again
    twice[order] = again | np.concatenate([same, [False]]) if len(key) else again[:0]
    return twice, before


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _covered(flags: np.ndarray, n: int, most: int) -> np.ndarray:
    """Words inside a flagged window of n words (windows are known by their first word)."""
    at = np.flatnonzero(flags)
    marks = np.bincount(at, minlength=most + 1) - np.bincount(at + n, minlength=most + 1)
    return np.cumsum(marks[:-1]) > 0


def measure(column, lengths=tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    raw, off = C.text_bytes(column)
    starts, ends, first = C.word_spans(~_SPACE[raw], off)
    lead = (raw & 0xC0) != 0x80  # first bytes of code points
    points = np.concatenate([[0], np.cumsum(lead)])
    chars = points[ends] - points[starts]
    hashes = C.span_hashes(raw, starts, ends)
    n_words, n = np.diff(first), len(starts)
    row = np.repeat(np.arange(len(n_words)), n_words)
    left = np.repeat(first[1:], n_words) - np.arange(n)  # words from here to the row's end
    out = {"n_words": n_words, "word_chars": _sums(chars, first), "n_symbols": _sums(_SYMBOL[raw], off)}

    # Lines: from a row's start or a \n to the next \n or the row's end; only those with a word.
    breaks = np.flatnonzero(raw == 10)
    line_start = np.concatenate([off[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(len(n_words)), np.searchsorted(off, breaks, "right") - 1])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, line_start)], off[line_row + 1])
    word_at = np.searchsorted(starts, line_start)
    has_word = np.append(starts, len(raw) + 1)[word_at] < line_end
    line_start, line_end, line_row, word_at = line_start[has_word], line_end[has_word], line_row[has_word], word_at[has_word]
    _, before = _repeated(line_row, C.span_hashes(raw, line_start, line_end))
    out["n_dup_lines"] = np.bincount(line_row[before], minlength=len(n_words))
    word_sum = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_sum[np.searchsorted(starts, line_end)] - word_sum[word_at]
    out["line_coverage"] = np.bincount(line_row[before], weights=line_chars[before], minlength=len(n_words))

    # n-grams: the hash of n words rolls on from that of n - 1.
    rolling = hashes
    for k in range(2, max((3, *lengths)) + 1):
        rolling = C.mix(rolling[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[k - 1 :]) if len(rolling) > 1 else rolling[:0]
        if k != 3 and k not in lengths:
            continue
        whole = np.flatnonzero(left[: len(rolling)] >= k)
        flags = np.zeros(n, bool)
        twice, _ = _repeated(row[whole], rolling[whole])
        flags[whole[twice]] = True
        inside = _covered(flags, k, n)
        if k == 3:
            out["n_repeat_words"] = _sums(inside, first)
        if k in lengths:
            out[f"coverage_{k}"] = _sums(np.where(inside, chars, 0), first)
    return out


def score_quality(docs: DataFrame, text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """``docs`` with the measures and the method's verdict ``__ok``.

    ``__coverage``: for each n of ``limits`` the share of word characters inside n-grams that
    stand twice or more, then the share inside lines that stood before. Null or empty text has no
    words, covers nothing and is ok; rows are judged alone, repeated ones alike; other columns
    stay as they are, but for one with a result's name, which the result replaces."""
    limits = NGRAM_LIMITS if limits is None else limits
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(text: pa.Array) -> list[pa.Array]:
        m = measure(text, tuple(limits))
        whole = np.maximum(m["word_chars"], 1)
        shares = np.stack([*(m[f"coverage_{k}"] / whole for k in limits), m["line_coverage"] / whole], 1)
        ok = (shares <= np.array([*limits.values(), line_limit])).all(1)
        return [*(pa.array(m[x], pa.int64()) for x in own), C.list_array(shares.ravel(), np.full(len(ok), shares.shape[1]), pa.float64()), pa.array(ok)]

    return C.map_docs(docs, text_col, run, ", ".join([*(f"__{x} long" for x in own), "__coverage array<double>, __ok boolean"]))
