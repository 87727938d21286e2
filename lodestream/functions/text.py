"""Features of text as array expressions: tokens, n-grams, skip-grams, affixes, shapes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exploration import let


def tokens(text: Column) -> Column:
    """Words between spaces and tabs; the separators of the text format become underscores."""
    return F.filter(F.split(F.translate(text, ":|", "__"), "[ \t]"), lambda w: w != "")


def ngrams(words: Column, n: int, skips: int = 0, up_to: bool = True) -> Column:
    """n-grams joined by ^, of 2 to n words (or of n alone); with skips up to that many words in all may be left out."""

    def of(held: Column) -> Column:
        return F.concat(*[_grams(held, offsets) for size in range(2 if up_to else n, n + 1) for offsets in _offsets(size, skips)])

    return let(words, of)


def _grams(words: Column, offsets: tuple[int, ...]) -> Column:
    """The words at the offsets from each place, joined: shifted arrays meet place by place."""
    many = F.greatest(F.size(words) - offsets[-1], F.lit(0))
    out = F.slice(words, F.lit(1), many)
    for k in offsets[1:]:
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), many), lambda a, b: F.concat(a, F.lit("^"), b))
    return out


def _offsets(size: int, skips: int):
    """Places of an n-gram's words after its first: strictly rising, at most ``skips`` left out."""
    for rest in combinations(range(1, size + skips), size - 1):
        yield (0, *rest)


def affix(words: Column, length: int) -> Column:
    """Prefixes (length above 0) or suffixes (below) of the words."""
    cut = (lambda w: F.left(w, F.lit(length))) if length > 0 else (lambda w: F.right(w, F.lit(-length)))
    return F.transform(words, cut)


def shape(words: Column) -> Column:
    """Each character by its kind: digit 0, lower case a, upper case A, full stop ., any other #."""
    kinds = (("[0-9]", "0"), ("[a-z]", "a"), ("[A-Z]", "A"), ("[^0aA.]", "#"))

    def of(w: Column) -> Column:
        for pattern, mark in kinds:
            w = F.regexp_replace(w, pattern, mark)
        return w

    return F.transform(words, of)
