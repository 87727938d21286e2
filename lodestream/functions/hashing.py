"""Feature hashing: murmur3 (x86, 32 bits, seeded) over UTF-8, as Arrow batches in numpy and for single strings.

Spark's own ``hash`` has a fixed seed and another rule for the last bytes, so it is no substitute.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed values of the hash functions and of the feature space.
MURMUR_C1, MURMUR_C2, MURMUR_N = 0xCC9E2D51, 0x1B873593, 0xE6546B64
MURMUR_F1, MURMUR_F2 = 0x85EBCA6B, 0xC2B2AE35
INTERACTION_PRIME = 16777619
CONSTANT_HASH = 11650396
DEFAULT_BITS = 18

_M = np.uint64(0xFFFFFFFF)


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return ((x << np.uint64(k)) | (x >> np.uint64(32 - k))) & _M


def murmur3_many(values: list[bytes], seeds: np.ndarray | int = 0) -> np.ndarray:
    """32-bit hashes; strings of one length are hashed side by side."""
    out = np.zeros(len(values), np.uint64)
    seed = np.broadcast_to(np.asarray(seeds, np.uint64) & _M, len(values))
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        data = np.frombuffer(b"".join(values[k] for k in rows), np.uint8).reshape(len(rows), n)
        h = seed[rows].copy()
        whole = n // 4
        words = np.ascontiguousarray(data[:, : 4 * whole]).view("<u4").astype(np.uint64)
        for k in range(whole):
            word = (words[:, k] * np.uint64(MURMUR_C1)) & _M
            h ^= (_rotated(word, 15) * np.uint64(MURMUR_C2)) & _M
            h = (_rotated(h, 13) * np.uint64(5) + np.uint64(MURMUR_N)) & _M
        if n % 4:
            word = np.zeros(len(rows), np.uint64)
            for k in range(n % 4):
                word |= data[:, 4 * whole + k].astype(np.uint64) << np.uint64(8 * k)
            h ^= (_rotated((word * np.uint64(MURMUR_C1)) & _M, 15) * np.uint64(MURMUR_C2)) & _M
        h ^= np.uint64(n)
        for shift, factor in ((16, MURMUR_F1), (13, MURMUR_F2)):
            h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & _M
        out[rows] = h ^ (h >> np.uint64(16))
    return out


def murmur3(value: bytes | str, seed: int = 0) -> int:
    return int(murmur3_many([value.encode() if isinstance(value, str) else value], seed)[0])


def name_hash(name: str, seed: int = 0, numbers: bool = True) -> int:
    """Hash of a feature's name: digits alone are that number added to the seed, unless ``numbers`` is off."""
    bare = name.strip("".join(map(chr, range(33))))
    if numbers and bare.isascii() and (bare.isdigit() or bare == ""):
        return (int(bare or 0) + seed) & 0xFFFFFFFF
    return murmur3(bare if numbers else name, seed)


_CONTROL = "".join(map(chr, range(33)))


def name_hashes(names: list[str], seeds: np.ndarray | int = 0) -> np.ndarray:
    """``name_hash`` of many names at once, each with its seed."""
    seeds = np.broadcast_to(np.asarray(seeds, np.int64), len(names))
    bare = [n.strip(_CONTROL) for n in names]
    out = murmur3_many([n.encode() for n in bare], seeds.astype(np.uint64))
    for k, n in enumerate(bare):
        if n == "" or n.isascii() and n.isdigit():
            out[k] = (int(n or 0) + int(seeds[k])) & 0xFFFFFFFF
    return out


def feature_hash(name: str, namespace: str = "", bits: int = DEFAULT_BITS, value: str | None = None, seed: int = 0, numbers: bool = True) -> int:
    """Index of a feature: its name seeded by its namespace's hash; a string value is seeded by the name's."""
    ns = name_hash(namespace, seed, numbers) if namespace else seed
    h = name_hash(name, ns, numbers)
    if value is not None:
        h = name_hash(value, h, numbers)
    return h & ((1 << bits) - 1)


def murmur3_column(value: Column, seed: Column) -> Column:
    """murmur3 of a string column with a seed column, in Arrow batches."""

    def run(v: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(murmur3_many([(x or "").encode() for x in v], s.to_numpy(np.int64).astype(np.uint64)).astype(np.int64))

    return F.pandas_udf(run, LongType())(value, seed)


def interact(a: Column, b: Column, bits: int = DEFAULT_BITS) -> Column:
    """Index of a pair of features from their 32-bit hashes, in Spark's own integers."""
    return (F.pmod(a * INTERACTION_PRIME, F.lit(1 << 32)).bitwiseXOR(b)).bitwiseAND(F.lit((1 << bits) - 1))


class Merand48:
    """The 48-bit congruential generator behind reproducible sampling: uniform, gaussian and Poisson(1) draws."""

    #: Fixed values of the generator.
    A, C, BIAS = 0xEECE66D5DEECE66D, 2147483647, 127 << 23

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFFFFFFFFFF

    def uniform(self) -> float:
        self.state = (self.A * self.state + self.C) & 0xFFFFFFFFFFFFFFFF
        bits = ((self.state >> 25) & 0x7FFFFF) | self.BIAS
        return float(np.uint32(bits).view(np.float32) - np.float32(1))

    def gaussian(self) -> float:
        """Polar method: a uniform point in the unit disk gives a normal deviate."""
        while True:
            a, b = 2 * self.uniform() - 1, 2 * self.uniform() - 1
            if 0 < (r := a * a + b * b) < 1:
                return float(a * np.sqrt(-2 * np.log(r) / r))

    def poisson1(self) -> int:
        """Inverse of the Poisson distribution with mean 1."""
        u, k, p = self.uniform(), 0, np.exp(-1.0)
        total = p
        while u > total and k < 20:
            k += 1
            p /= k
            total += p
        return k


def chained_index(namespace: Column, name: Column, value: Column, bits: int = DEFAULT_BITS) -> Column:
    """Index of a string feature by a chain of hashes, of the value seeded by that of the name, which
    the namespace's seeds, so that ``ns.name = value`` never collides with the text ``name=value``."""

    def run(ns: pd.Series, n: pd.Series, v: pd.Series) -> pd.Series:
        h = name_hashes(n.fillna("").tolist(), np.where(ns.fillna("") == "", 0, name_hashes(ns.fillna("").tolist())).astype(np.int64))
        return pd.Series(name_hashes(v.fillna("").tolist(), h.astype(np.int64)).astype(np.int64) & ((1 << bits) - 1))

    return F.pandas_udf(run, LongType())(namespace, name, value)


def draws(seed: Column) -> Column:
    """(uniform, poisson1) of a generator seeded by a column of whole numbers, each its first draw."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"uniform": [Merand48(int(x)).uniform() for x in s], "poisson": [Merand48(int(x)).poisson1() for x in s]})

    return F.pandas_udf(run, "uniform double, poisson long")(seed)
