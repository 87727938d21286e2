import math

import pytest
from pyspark.sql import functions as F

from lodestream.functions import estimators as E
from lodestream.functions import exploration as X
from lodestream.functions import hashing as H
from lodestream.functions import losses as L
from lodestream.functions import text as T
from lodestream.operators import features, reductions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_known_hashes():
    assert H.murmur3(b"", 0) == 0 and H.murmur3(b"", 1) == 0x514E28B7
    assert H.murmur3(b"abc", 0) == 0xB3DD93FA and H.murmur3(b"Hello, world!", 0x9747B28C) == 0x24884CBA
    assert list(H.murmur3_many([b"abc", b"", b"Hello, world!"], 0)) == [H.murmur3(b"abc"), 0, H.murmur3(b"Hello, world!")]
    assert H.name_hash("12", 5) == 17 and H.name_hash("12", 5, numbers=False) == H.murmur3("12", 5)
    assert H.feature_hash("x", "ns", 10) < 1024


def test_murmur3_column(spark):
    df = spark.createDataFrame([("abc", 0), ("", 1)], "v string, s long")
    assert [r[0] for r in df.select(H.murmur3_column(F.col("v"), F.col("s"))).collect()] == [0xB3DD93FA, 0x514E28B7]


def test_generator_is_reproducible():
    a, b = H.Merand48(7), H.Merand48(7)
    draws = [a.uniform() for _ in range(1000)]
    assert draws == [b.uniform() for _ in range(1000)] and all(0 <= x < 1 for x in draws) and abs(sum(draws) / 1000 - 0.5) < 0.05
    c = H.Merand48(3)
    assert abs(sum(c.gaussian() for _ in range(2000)) / 2000) < 0.1
    assert abs(sum(c.poisson1() for _ in range(2000)) / 2000 - 1) < 0.1


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.epsilon_greedy(arr(1, 0, 0, 2), 0.2), [0.05, 0.45, 0.45, 0.05]),
        (lambda: X.squarecb(arr(0, 1), 2.0), [0.75, 0.25]),
        (lambda: X.minimum_probability(arr(1, 0), 0.2), [0.9, 0.1]),
        (lambda: X.minimum_probability(arr(1, 0), 0.2, raise_zeros=False), [1.0, 0.0]),
        (lambda: X.mix_uniform(arr(1, 0), 0.2), [0.9, 0.1]),
        (lambda: X.bag(arr(3, 1)), [0.75, 0.25]),
        (lambda: X.explore_first(arr(1, 0), F.lit(5), 3), [0.0, 1.0]),
        (lambda: X.explore_first(arr(1, 0), F.lit(2), 3), [0.5, 0.5]),
        (lambda: reductions.wap_values(arr(0, 1, 3)), [0.0, 1.0, 2.0]),
        (lambda: reductions.mc_weights(arr(0, 1, 2))[0], [-1.0, 1.0, 1.0]),
        (lambda: reductions.mc_weights(arr(0, 1, 2))[1], [2.0, 1.0, 2.0]),
        (lambda: X.softmax(arr(0, 0), 1.0), [0.5, 0.5]),
        (lambda: X.synthetic_cover(arr(0, 10), 1.0, 10), [1.0, 0.0]),
    ],
)
def test_array_functions(spark, column, want):
    assert one(spark, column()) == pytest.approx(want)


def test_text_features(spark):
    words = F.split(F.lit("a b c"), " ")
    assert one(spark, T.ngrams(words, 3)) == ["a^b", "b^c", "a^b^c"]
    assert set(one(spark, T.ngrams(words, 2, skips=1))) == {"a^b", "b^c", "a^c"}
    assert one(spark, T.ngrams(F.split(F.lit("a"), " "), 3)) == []
    assert one(spark, T.shape(F.array(F.lit("Ab1.-é")))) == ["Aa0.##"]
    assert one(spark, T.affix(F.array(F.lit("hello"), F.lit("a")), -2)) == ["lo", "a"]


def test_interactions(spark):
    f = lambda ns, n: features.feature(ns, F.lit(n), 2.0)
    a3 = F.array(f("a", "1"), f("a", "2"), f("a", "3"), f("b", "x"))
    assert len(one(spark, features.interactions(a3, ["a", "a"]))) == 6
    assert len(one(spark, features.interactions(a3, ["a", "a"], permutations=True))) == 9
    assert len(one(spark, features.interactions(a3, ["a", "a", "a"]))) == 10
    assert len(one(spark, features.interactions(a3, ["a", "a", "b"]))) == 6
    assert features.expand_wildcards(["::"], ["a", "b"]) == [("a", "a"), ("a", "b"), ("b", "b")]
    assert features.expand_wildcards(["ab", "ba"], []) == [("a", "b")]
    assert [x["ns"] for x in one(spark, features.redefine(a3, [("z", "b")]))] == ["a", "a", "a", "z"]


def test_sampling_and_densities(spark):
    assert [one(spark, X.sample(arr(0.5, 0.5), F.lit(u))) for u in (0.0, 0.49, 0.5, 0.99)] == [0, 0, 1, 1]
    seg = E.pmf_to_pdf(F.lit(0.1), 0.0, 1.0, 0.2)
    assert one(spark, E.sample_pdf(seg, F.lit(0.5))) == pytest.approx(0.15)
    assert one(spark, E.pseudo_inverse(F.lit(0.8), arr(0.4, 0.3), arr(0.8, 0.6))) == pytest.approx(0.8 * (0.5 + 0.5 - 1))
    assert one(spark, X.swap_to_front(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(2))) == [3, 2, 1]
    assert one(spark, X.order_actions(arr(0.2, 0.4, 0.4), arr(0, 2, 1))) == [2, 1, 0]
    assert one(spark, X.epsilon_schedule(1.0, F.lit(7))) == pytest.approx(0.5)


def test_losses(spark):
    p, y = F.lit(2.0), F.lit(1.0)
    assert one(spark, L.squared(F.lit(2.0), F.lit(-1.0), -1.0, 1.0)) == pytest.approx(4 + 2 * 2 * 1)
    assert one(spark, L.hinge(p, y)) == 0 and one(spark, L.logistic(p, y)) == pytest.approx(math.log1p(math.exp(-2)))
    assert one(spark, L.clamp(F.lit(float("nan")), -1, 1)) == 0
    for name in ("squared", "logistic", "poisson", "expectile"):
        f = L.classic if name == "squared" else L.LOSSES[name]
        slope = (one(spark, f(F.lit(0.3 + 1e-5), y)) - one(spark, f(F.lit(0.3 - 1e-5), y))) / 2e-5
        assert one(spark, L.derivative(name, F.lit(0.3), y)) == pytest.approx(slope, abs=1e-3)


def test_bounds():
    n, w, r = 1000, [1.0] * 1000, [0.5 + 0.1 * (-1) ** k for k in range(1000)]
    low = E.chi2_lower_bound(n, sum(w), sum(x * x for x in w), sum(a * b for a, b in zip(w, r)), sum(a * a * b for a, b in zip(w, r)), sum((a * b) ** 2 for a, b in zip(w, r)))
    assert 0.4 < low < 0.5
    assert E._chi2_isf(0.05) == pytest.approx(3.8415, abs=1e-3)
