"""Online learners against SQL: each learner's fold over a user's events as a recursive query.

The bases of composed learners here take plain gradient steps of one size, which SQL can say;
with their default bases the same learners are registered in ``learning``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..functions import exploration as X
from ..functions.hashing import Merand48
from ..operators import asking, composed, events, factors, features, online, simulation
from .data import COST_SCALE, LOG_SQL, action_costs, log
from .learning import _actions, _bandit, _stream, _typed
from .queries import ORACLE_SQL, QUERIES, r
from .stack import Stack


def lets(source: str, levels: list[dict[str, str]]) -> str:
    """``source`` with columns added level by level; a level sees those before it."""
    for level in levels:
        source = f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in level.items())} FROM {source})"
    return source


def fold_sql(columns: str, state: dict[str, tuple[str, str]], levels: list[dict[str, str]], out: str, order: str = "event_id") -> str:
    """A fold over each user's events. ``columns`` come from the log; ``state`` has each variable's
    first value and its next one, in terms of columns, variables and ``levels``' lets; ``out`` is
    selected with the state that an event finds."""
    first = ", ".join(f"{a} AS {k}" for k, (a, _) in state.items())
    after = ", ".join(f"{b} AS {k}" for k, (_, b) in state.items())
    names = ", ".join(f"b.{k}" for k in state)
    return f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT user_id, event_id, {columns}, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS n FROM log),
s AS (SELECT o.*, {first} FROM o WHERE n = 1
 UNION ALL SELECT o.*, {names} FROM (SELECT user_id, n, {after} FROM {lets('s', levels)}) b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)
SELECT {out} FROM {lets('s', levels)}"""


def register(name: str, f, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = f, sql


# --- base learners on a value and a constant ------------------------------------------------------

D0 = "0.0::DOUBLE"
_SLOPE = "(-y / (1 + exp(least(y * p, 500))))"


def _dense(name: str, make, state, levels, passes: int = 1) -> None:
    def run(spark, sf):
        out = online.train(_stream(spark, sf), online.Run(make, passes), ["user_id"]).where("kind = 'prediction'")
        return out.select(F.col("seq").alias("event_id"), (r("p") + 0.0).alias("p"))

    register(name, run, fold_sql("x, y", state, levels, "event_id, round(p, 6) + 0.0 AS p"))


def _zeros(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, D0)


# Normalised, adaptive, importance-invariant descent on the logistic loss.
_root = "list_reduce(range(60), lambda v, i: v - (v + exp(v) - target) / (1 + exp(v)), CASE WHEN target > 1 THEN ln(target) ELSE target END)"
_gd = [
    {"p": "least(greatest(u * x + v, -50), 50)", "xx": "greatest(x * x, 1.17549435e-38::DOUBLE)"},
    {"sl": _SLOPE, "nu2": "greatest(nu, sqrt(xx))", "nv2": "greatest(nv, 1.0::DOUBLE)"},
    {"u1": "u * CASE WHEN nu > 0 AND sqrt(xx) > nu THEN nu / sqrt(xx) ELSE 1 END", "ns2": "ns + xx / (nu2 * nu2) + 1 / (nv2 * nv2)", "gu2": "gu + sl * sl * xx", "gv2": "gv + sl * sl"},
    {"ru": "1 / sqrt(greatest(gu2, 1e-300)) / nu2", "rv": "1 / sqrt(greatest(gv2, 1e-300)) / nv2", "m": "sqrt(tw1 / ns2)"},
    {"per": "(ru * xx + rv) * m"},
    {"target": "y * p + exp(least(y * p, 500)) + 0.5::DOUBLE * per"},
    {"step": f"y * ({_root} - y * p) / per"},
]
_dense(
    "gd_fold", lambda: online.GD(loss="logistic", bits=1),
    {"u": (D0, "u1 + step * m * ru * x"), "v": (D0, "v + step * m * rv"), "gu": (D0, "gu2"), "gv": (D0, "gv2"), "nu": (D0, "nu2"), "nv": (D0, "nv2"), "ns": (D0, "ns2"), "tw1": ("1.0::DOUBLE", "tw1 + 1")},
    _gd,
)

# The same on squared loss, whose invariant step has a closed form; predictions stay between the labels seen.
_gd2 = [
    {"lo2": "least(lo, y)", "hi2": "greatest(hi, y)", "xx": "greatest(x * x, 1.17549435e-38::DOUBLE)"},
    {"p": "least(greatest(u * x + v, lo2), hi2)"},
    {"sl": "2 * (p - y)", "nu2": "greatest(nu, sqrt(xx))", "nv2": "greatest(nv, 1.0::DOUBLE)"},
    {"u1": "u * CASE WHEN nu > 0 AND sqrt(xx) > nu THEN nu / sqrt(xx) ELSE 1 END", "ns2": "ns + xx / (nu2 * nu2) + 1 / (nv2 * nv2)", "gu2": "gu + sl * sl * xx", "gv2": "gv + sl * sl"},
    {"ru": "1 / sqrt(greatest(gu2, 1e-300)) / nu2", "rv": "1 / sqrt(greatest(gv2, 1e-300)) / nv2", "m": "sqrt(tw1 / ns2)"},
    {"per": "(ru * xx + rv) * m"},
    {"step": "CASE WHEN sl = 0 THEN 0 ELSE (y - p) * (1 - exp(-2 * 0.5::DOUBLE * per)) / per END"},
]
_dense(
    "gd_squared_fold", lambda: online.GD(loss="squared", bits=1),
    {"u": (D0, "u1 + step * m * ru * x"), "v": (D0, "v + step * m * rv"), "gu": (D0, "gu2"), "gv": (D0, "gv2"), "nu": (D0, "nu2"), "nv": (D0, "nv2"), "ns": (D0, "ns2"), "tw1": ("1.0::DOUBLE", "tw1 + 1"), "lo": (D0, "lo2"), "hi": (D0, "hi2")},
    _gd2,
)

_pistol_w = "CASE WHEN {m} * ({g} + {m}) > 0 THEN sqrt({g}) * 0.5::DOUBLE * {t} * exp(least({t} * {t} / (2 * {m} * ({g} + {m})), 500)) / ({m} * ({g} + {m})) ELSE 0.0::DOUBLE END"
_dense(
    "pistol_fold", lambda: online.Pistol(bits=1),
    {"tu": (D0, "tu - sl * x"), "tv": (D0, "tv - sl"), "gu": (D0, "gu + abs(sl * x)"), "gv": (D0, "gv + abs(sl)"), "mu": (D0, "mu2"), "mv": (D0, "1.0::DOUBLE")},
    [{"mu2": "greatest(mu, abs(x))"}, {"p": f"x * {_pistol_w.format(m='mu2', g='gu', t='tu')} + {_pistol_w.format(m='1.0::DOUBLE', g='gv', t='tv')}"}, {"sl": _SLOPE}],
)

_coin_w = "CASE WHEN {m} * {x} * ({m} * {x} + {g}) > 0 THEN (4 + {r}) / ({m} * {x} * ({m} * {x} + {g})) * {z} ELSE 0.0::DOUBLE END"
_dense(
    "coin_fold", lambda: online.Coin(bits=1),
    {"zu": (D0, "zu - sl * x"), "zv": (D0, "zv - sl"), "gu": (D0, "gu + abs(sl * x)"), "gv": (D0, "gv + abs(sl)"), "mu": (D0, "greatest(mu, abs(sl))"), "mv": (D0, "greatest(mv, abs(sl))"), "xu": (D0, "xu2"), "xv": (D0, "1.0::DOUBLE"), "ru": (D0, "ru + greatest(-sl * x * wu, -0.5::DOUBLE * ru)"), "rv": (D0, "rv + greatest(-sl * wv, -0.5::DOUBLE * rv)"), "norm": (D0, "norm2")},
    [
        {"xu2": "greatest(xu, abs(x))"},
        {"norm2": "norm + (x / greatest(xu2, 1e-300)) * (x / greatest(xu2, 1e-300)) + 1", "wu": _coin_w.format(m="mu", x="xu2", g="gu", r="ru", z="zu"), "wv": _coin_w.format(m="mv", x="1.0::DOUBLE", g="gv", r="rv", z="zv")},
        {"p": "(wu * x + wv) / greatest(norm2 / n, 1e-12)"},
        {"sl": _SLOPE},
    ],
)

_free_w = "CASE WHEN {h} > 0 AND {v} > 0 THEN -sign({g}) * abs({g}) * (2 * {v} + {t} * abs({g})) * {h} * {h} / (2 * ({v} + {t} * abs({g})) * ({v} + {t} * abs({g})) * sqrt({v})) * exp(least({g} * {g} / (2 * {v} + 2 * {t} * abs({g})), 500)) ELSE 0.0::DOUBLE END"


def _free_state(k: str, g: str) -> tuple[dict, dict]:
    clipped = f"CASE WHEN abs({g}) > t{k} AND t{k} > 0 THEN sign({g}) * t{k} ELSE {g} END"
    return {f"c{k}": clipped}, {f"g{k}": (D0, f"g{k} + c{k}"), f"v{k}": (D0, f"v{k} + c{k} * c{k}"), f"h{k}": (D0, f"CASE WHEN h{k} = 0 AND abs({g}) > 0 THEN abs({g}) ELSE h{k} END"), f"t{k}": (D0, f"greatest(t{k}, abs({g}))")}


_cu, _su = _free_state("u", "(sl * x)")
_cv, _sv = _free_state("v", "sl")
_dense(
    "freegrad_fold", lambda: online.FreeGrad(bits=1), _su | _sv,
    [{"p": f"x * {_free_w.format(h='hu', v='vu', g='gu', t='tu')} + {_free_w.format(h='hv', v='vv', g='gv', t='tv')}"}, {"sl": _SLOPE}, _cu | _cv],
)

_dense("noop_fold", online.Noop, {"z": (D0, D0)}, [{"p": D0}])

# A constant first, then the model on what the constant leaves; plain steps of 0.1 on squared loss.
_dense(
    "baseline_plain_fold", lambda: composed.Baseline(bits=1, make=lambda bits, loss="squared", **more: composed.plain(0.1)(bits, loss, low=-1e9, high=1e9)),
    {"c": (D0, "c + 0.2::DOUBLE * (y - cp)"), "u": (D0, "u + 0.2::DOUBLE * (rest - rp) * x"), "v": (D0, "v + 0.2::DOUBLE * (rest - rp)"), "lo": (D0, "lo2"), "hi": (D0, "hi2"), "rlo": (D0, "rlo2"), "rhi": (D0, "rhi2")},
    [
        {"lo2": "least(lo, y)", "hi2": "greatest(hi, y)", "shown": "least(greatest(c, lo), hi)", "rr": "u * x + v"},
        {"cp": "least(greatest(c, lo2), hi2)", "p": "shown + rr"},
        {"rest": "y - cp"},
        {"rlo2": "least(rlo, rest)", "rhi2": "greatest(rhi, rest)"},
        {"rp": "least(greatest(rr, rlo2), rhi2)"},
    ],
)


# --- multiclass reductions over two hashed features an event --------------------------------------

_TYPED = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS y, k % 16 AS i1, 16 + CAST(floor(value / 25) AS INTEGER) % 16 AS i2"
SLOTS = 32


def _score(slot: str) -> str:
    return f"w[({slot}) * {SLOTS} + i1 + 1] + w[({slot}) * {SLOTS} + i2 + 1]"


def _moved(steps: str) -> str:
    """Weights after each slot c moved by steps[c + 1] along its features."""
    return f"list_transform(w, lambda z, j: CASE WHEN (j - 1) % {SLOTS} = i1 OR (j - 1) % {SLOTS} = i2 THEN z + {steps}[(j - 1) // {SLOTS} + 1] ELSE z END)"


def _start(slots: int) -> str:
    return f"list_transform(range({slots * SLOTS}), lambda z: 0.0::DOUBLE)"


def _multi(name: str, make, state, levels, p: str = "p", shift: int = 0) -> None:
    def run(spark, sf):
        rows = _typed(spark, sf).withColumn("y", F.col("y") - shift)
        out = online.train(rows, online.Run(make), ["user_id"]).where("kind = 'prediction'")
        return out.select("user_id", F.col("seq").alias("event_id"), r("p").alias("p"))

    register(name, run, fold_sql(_TYPED, state, levels, f"user_id, event_id, round(CAST({p} AS DOUBLE), 6) AS p"))


def _logistic_step(y: str, score: str) -> str:
    return f"0.1::DOUBLE * ({y} / (1 + exp({y} * greatest(least({score}, 50), -50))))"


_multi(
    "oaa_plain_online", lambda: composed.OneAgainstAll(classes=5, bits=5, make=composed.plain()),
    {"w": (_start(5), _moved("st"))},
    [
        {"sc": f"[{_score('c')} FOR c IN range(5)]"},
        {"p": "list_position(sc, list_max(sc))", "st": f"[{_logistic_step('(CASE WHEN y = c + 1 THEN 1 ELSE -1 END)', 'sc[c + 1]')} FOR c IN range(5)]"},
    ],
)

# Boost by majority, three weak learners: weights from the margin of those before.
_boost = [{"sc": f"[{_score('c')} FOR c IN range(3)]", "yy": "CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"}, {"vt": "[CASE WHEN sc[c + 1] > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FOR c IN range(3)]"}]
_boost += [{"p": "CASE WHEN list_sum(vt) > 0 THEN 1 ELSE -1 END", "mg": "[0.0::DOUBLE, yy * vt[1], yy * vt[1] + yy * vt[2]]"}]
_boost += [{"ways": "[floor((3 - c - mg[c + 1]) / 2) FOR c IN range(3)]"}]
_choose = "CASE WHEN c = 0 THEN [1, 2, 1][CAST(ways[1] AS INTEGER) + 1] WHEN c = 1 THEN [1, 1][CAST(ways[2] AS INTEGER) + 1] ELSE [1][CAST(ways[3] AS INTEGER) + 1] END"
_boost += [{"bw": f"[CASE WHEN ways[c + 1] < 0 OR ways[c + 1] > 2 - c THEN 0.0::DOUBLE ELSE ({_choose}) * pow(0.6::DOUBLE, ways[c + 1]) * pow(0.4::DOUBLE, 2 - c - ways[c + 1]) END FOR c IN range(3)]"}]
_boost += [{"st": f"[bw[c + 1] * {_logistic_step('yy', 'sc[c + 1]')} FOR c IN range(3)]"}]


def _boosting(spark, sf):
    rows = _typed(spark, sf).withColumn("y", F.when(F.col("y") == 1, 1.0).otherwise(-1.0))
    out = online.train(rows, online.Run(lambda: composed.Boosting(learners=3, bits=5, make=composed.plain())), ["user_id"]).where("kind = 'prediction'")
    return out.select("user_id", F.col("seq").alias("event_id"), r("p").alias("p"))


register("boosting_plain_online", _boosting, fold_sql(_TYPED, {"w": (_start(3), _moved("st"))}, _boost, "user_id, event_id, round(CAST(p AS DOUBLE), 6) AS p"))

# Probabilistic label tree of 4 labels and 3 inner nodes: a label's nodes learn +1, their siblings -1.
_plt = [
    {"sc": f"[{_score('c')} FOR c IN range(7)]", "leaf": "y % 4 + 3"},
    {"pr": "[1 / (1 + exp(-greatest(least(sc[c + 1], 50), -50))) FOR c IN range(7)]", "up": "(leaf - 1) // 2"},
    {"lab": "[pr[1] * pr[(c + 3 - 1) // 2 + 1] * pr[c + 3 + 1] FOR c IN range(4)]"},
    {"sg": "[CASE WHEN c = 0 OR c = up OR c = leaf THEN 1.0::DOUBLE WHEN c <> 0 AND ((c - 1) // 2 = 0 OR (c - 1) // 2 = up) THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END FOR c IN range(7)]"},
    {"p": "list_position(lab, list_max(lab)) - 1", "st": f"[CASE WHEN sg[c + 1] = 0 THEN 0.0::DOUBLE ELSE {_logistic_step('sg[c + 1]', 'sc[c + 1]')} END FOR c IN range(7)]"},
]


def _label_tree(spark, sf):
    rows = _typed(spark, sf).withColumn("y", F.col("y") % 4)
    out = online.train(rows, online.Run(lambda: composed.LabelTree(labels=4, bits=5, make=composed.plain())), ["user_id"]).where("kind = 'prediction'")
    return out.select("user_id", F.col("seq").alias("event_id"), r("p").alias("p"))


register("plt_plain_online", _label_tree, fold_sql(_TYPED, {"w": (_start(7), _moved("st"))}, _plt, "user_id, event_id, round(CAST(p AS DOUBLE), 6) AS p"))


# --- contextual bandits over five actions ---------------------------------------------------------

WIDE = 64
_CB = "a, cost, p AS lp, [j FOR j IN range(5)] AS act, 8 + k % 8 AS sh, [16 + j * 8 + k % 8 FOR j IN range(5)] AS own"


def _costs(w: str = "w") -> str:
    return f"[{w}[j + 1] + 0.5::DOUBLE * {w}[sh + 1] + {w}[own[j + 1] + 1] FOR j IN range(5)]"


def _wide_start() -> str:
    return f"list_transform(range({WIDE}), lambda z: 0.0::DOUBLE)"


def _step_level(k: int, w: str, j: str, target: str, weight: str = "1", extra: int | None = None) -> tuple[list[dict[str, str]], str]:
    """Levels of one squared-loss step of action ``j`` towards ``target`` (weights named w, bounds lo, hi);
    ``extra`` is one more feature of the example."""
    raw = f"{w}[({j}) + 1] + 0.5::DOUBLE * {w}[sh + 1] + {w}[own[({j}) + 1] + 1]" + (f" + {w}[{extra + 1}]" if extra is not None else "")
    a, name = f"{w}_{k}", w.split("_")[0]
    lo, hi = (f"{name}_lo" if k == 0 else f"{name}_lo{k}"), (f"{name}_hi" if k == 0 else f"{name}_hi{k}")
    levels = [
        {f"{name}_t{k}": f"({target})"},
        {f"{name}_lo{k + 1}": f"least({lo}, {name}_t{k})", f"{name}_hi{k + 1}": f"greatest({hi}, {name}_t{k})"},
        {f"{name}_m{k}": f"0.2::DOUBLE * ({weight}) * ({name}_t{k} - least(greatest({raw}, {name}_lo{k + 1}), {name}_hi{k + 1}))"},
        {a: f"list_transform({w}, lambda z, i: z + {name}_m{k} * CASE WHEN i - 1 = ({j}) OR i - 1 = own[({j}) + 1]{'' if extra is None else f' OR i - 1 = {extra}'} THEN 1 WHEN i - 1 = sh THEN 0.5::DOUBLE ELSE 0 END)"},
    ]
    return levels, a


_DISTRIBUTIONS = {
    "epsilon": "[0.01::DOUBLE + 0.95::DOUBLE * CASE WHEN cs[j + 1] = list_min(cs) THEN 1 ELSE 0 END / len(list_filter(cs, lambda z: z = list_min(cs))) FOR j IN range(5)]",
    "softmax": "[exp(-(cs[j + 1] - list_min(cs))) / list_sum([exp(-(z - list_min(cs))) FOR z IN cs]) FOR j IN range(5)]",
    "squarecb": "[CASE WHEN j + 1 = list_position(cs, list_min(cs)) THEN 1 - list_sum([CASE WHEN i + 1 = list_position(cs, list_min(cs)) THEN 0 ELSE 1 / (5 + 10 * sqrt(greatest(n - 1, 1)) * (cs[i + 1] - list_min(cs))) END FOR i IN range(5)]) ELSE 1 / (5 + 10 * sqrt(greatest(n - 1, 1)) * (cs[j + 1] - list_min(cs))) END FOR j IN range(5)]",
    "first": "[CASE WHEN n - 1 < 10 THEN 0.2::DOUBLE WHEN j + 1 = list_position(cs, list_min(cs)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR j IN range(5)]",
}


def _policy(name: str, estimator: str, explore: str) -> None:
    levels = [{"cs": _costs()}, {"dist": _DISTRIBUTIONS[explore]}]
    w, state = "w", {"w": None, "w_lo": None, "w_hi": None}
    if estimator == "mtr":
        more, w = _step_level(0, "w", "a", "cost", "1 / lp / 5")
        levels += more
        last = 1
    else:
        if estimator in ("dr", "dm"):
            levels.append({"gs": _costs("q")})
            state |= {"q": None, "q_lo": None, "q_hi": None}
        else:
            levels.append({"gs": "[0.0::DOUBLE FOR j IN range(5)]"})
        levels.append({"tg": "[gs[j + 1] + CASE WHEN j = a THEN (cost - gs[j + 1]) / lp ELSE 0 END FOR j IN range(5)]" if estimator != "dm" else "gs"})
        for j in range(5):
            target = f"tg[{j + 1}]"
            raw_name = w
            more, w = _step_level(j, raw_name, str(j), target)
            levels += more
        last = 5
        if estimator in ("dr", "dm"):
            more, q = _step_level(0, "q", "a", "cost")
            levels += more
    state["w"], state["w_lo"], state["w_hi"] = (_wide_start(), w), (D0, f"w_lo{last}"), (D0, f"w_hi{last}")
    if "q" in state:
        state["q"], state["q_lo"], state["q_hi"] = (_wide_start(), "q_0"), (D0, "q_lo1"), (D0, "q_hi1")

    def query(spark, sf):
        def run(rows):
            policy = composed.Policy(bits=6, estimator=estimator, explore=explore, make=composed.plain())
            return [{"event_id": x["event_id"], "p": round(float(policy.learn(_actions(x), x["a"], x["cost"], x["p"])[x["a"]]), 5)} for x in rows]

        return _bandit(spark, sf, run, [("event_id", pa.int64()), ("p", pa.float64())])

    register(name, query, fold_sql(_CB, state, levels, "event_id, round(dist[a + 1], 5) AS p"))


for _estimator, _explore in (("mtr", "epsilon"), ("mtr", "softmax"), ("ips", "squarecb"), ("ips", "softmax"), ("dr", "softmax"), ("dm", "softmax"), ("dr", "first")):
    _policy(f"cb_adf_{_estimator}_{_explore}_plain", _estimator, _explore)

# --- the softmax estimator, cost-sensitive events, offset trees -----------------------------------


def _events(name: str, make, state, levels, out: str, answer) -> None:
    """A learner of five actions an event; ``answer`` (learner, row) gives the columns after event_id."""

    def query(spark, sf):
        def run(rows):
            learner = make()
            return [{"event_id": x["event_id"], "p": answer(learner, x)} for x in rows]

        return _bandit(spark, sf, run, [("event_id", pa.int64()), ("p", pa.float64())])

    register(name, query, fold_sql(_CB, state, levels, out))


_sm_levels = [{"cs": _costs()}, {"pi": "[exp(list_min(cs) - z) / list_sum([exp(list_min(cs) - t) FOR t IN cs]) FOR z IN cs]"}, {"sign": "CASE WHEN cost < 0 THEN -1 ELSE 1 END", "wt": "abs(cost) / lp * pi[a + 1]"}]
_w = "w"
for _j in range(5):
    _more, _w = _step_level(_j, _w, str(_j), f"least(greatest(cs[{_j + 1}] + sign * CASE WHEN a = {_j} THEN 1 ELSE -1 END, -100), 100)", f"wt * CASE WHEN a = {_j} THEN 1 - pi[{_j + 1}] ELSE pi[{_j + 1}] END")
    _sm_levels += _more
_events(
    "cb_adf_sm_plain", lambda: composed.Policy(bits=6, estimator="sm", explore="softmax", make=composed.plain()),
    {"w": (_wide_start(), _w), "w_lo": (D0, "w_lo5"), "w_hi": (D0, "w_hi5")}, _sm_levels, "event_id, round(pi[a + 1], 5) AS p",
    lambda policy, x: round(float(policy.learn(_actions(x), x["a"], x["cost"], x["p"])[x["a"]]), 5),
)

_ALL = "[CAST(((k * (7 * (j + 3)) + event_id * (13 * (j + 1))) % 101) / 100.0 AS DOUBLE) FOR j IN range(5)] AS cc"
_RANKED = "list_position([len(list_filter(cs, lambda z: z < cs[j + 1])) + len([1 FOR i IN range(5) IF i < j AND cs[i + 1] = cs[j + 1]]) FOR j IN range(5)], 0) - 1"


def _action_costs(name: str, kind: str, levels, last) -> None:
    def query(spark, sf):
        def run(rows):
            learner = events.ActionCosts(kind, bits=6, make=composed.plain())
            return [{"event_id": x["event_id"], "best": learner.learn(_actions(x), x["costs"])[0]} for x in rows]

        return _bandit(spark, sf, run, [("event_id", pa.int64()), ("best", pa.int64())])

    state = {"w": (_wide_start(), last[0]), "w_lo": (D0, last[1]), "w_hi": (D0, last[2])}
    register(name, query, fold_sql(f"{_CB}, {_ALL}", state, [{"cs": _costs()}, *levels], f"event_id, {_RANKED} AS best"))


def _in_turn(targets: list[str], weights: list[str]):
    levels, w = [], "w"
    for j in range(5):
        more, w = _step_level(j, w, str(j), targets[j], weights[j])
        levels += more
    return levels, (w, "w_lo5", "w_hi5")


_action_costs("csoaa_ldf_plain", "regression", *_in_turn([f"cc[{j + 1}]" for j in range(5)], ["1"] * 5))
# The scorer of a class that carries no weight is left alone; here that is a step of 0 and a bound of 0.
_mc = _in_turn([f"CASE WHEN {{w}} = 0 THEN 0 WHEN cc[{j + 1}] = list_min(cc) THEN -1.0 ELSE 1.0 END".replace("{w}", f"(CASE WHEN cc[{j + 1}] = list_min(cc) THEN list_max(cc) ELSE cc[{j + 1}] END - list_min(cc))") for j in range(5)], [f"(CASE WHEN cc[{j + 1}] = list_min(cc) THEN list_max(cc) ELSE cc[{j + 1}] END - list_min(cc))" for j in range(5)])
_action_costs("csoaa_ldf_mc_plain", "classifier", *_mc)

# All pairs: a step along the difference of two actions' features (the shared one cancels).
_pairs, _w = [{"srt": "list_sort(cc)"}, {"vv": "[coalesce(list_sum([(srt[r + 1] - srt[r]) / r FOR r IN range(1, 5) IF srt[r + 1] <= c]), 0.0) FOR c IN cc]"}], "w"
_k = 0
for _a in range(5):
    for _b in range(_a + 1, 5):
        _raw = f"{_w}[{_a + 1}] + {_w}[own[{_a + 1}] + 1] - {_w}[{_b + 1}] - {_w}[own[{_b + 1}] + 1]"
        _lo, _hi = ("w_lo", "w_hi") if _k == 0 else (f"w_lo{_k}", f"w_hi{_k}")
        _pairs += [
            {f"gap{_k}": f"abs(vv[{_a + 1}] - vv[{_b + 1}])"},
            {f"y{_k}": f"CASE WHEN gap{_k} < 1e-6 THEN 0 WHEN cc[{_a + 1}] < cc[{_b + 1}] THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"},
            {f"w_lo{_k + 1}": f"least({_lo}, y{_k})", f"w_hi{_k + 1}": f"greatest({_hi}, y{_k})"},
            {f"m{_k}": f"CASE WHEN gap{_k} < 1e-6 THEN 0.0 ELSE 0.2::DOUBLE * gap{_k} * (y{_k} - least(greatest({_raw}, w_lo{_k + 1}), w_hi{_k + 1})) END"},
            {f"w_p{_k}": f"list_transform({_w}, lambda z, i: z + m{_k} * CASE WHEN i - 1 = {_a} OR i - 1 = own[{_a + 1}] THEN 1 WHEN i - 1 = {_b} OR i - 1 = own[{_b + 1}] THEN -1 ELSE 0 END)"},
        ]
        _w = f"w_p{_k}"
        _k += 1
_action_costs("wap_ldf_plain", "pairs", _pairs, (_w, f"w_lo{_k}", f"w_hi{_k}"))


def _csoaa(spark, sf):
    rows = _typed(spark, sf).drop("y").join(log(spark, sf).select(F.col("event_id").alias("seq"), action_costs().alias("y")), "seq")
    out = online.train(rows, online.Run(lambda: events.CostSensitive(classes=5, bits=5, make=composed.plain())), ["user_id"]).where("kind = 'prediction'")
    return out.select("user_id", F.col("seq").alias("event_id"), r("p").alias("p"))


_cs = [
    {"sc": f"[{_score('c')} FOR c IN range(5)]", "lo2": "[least(lo[c + 1], cc[c + 1]) FOR c IN range(5)]", "hi2": "[greatest(hi[c + 1], cc[c + 1]) FOR c IN range(5)]"},
    {"p": "list_position(sc, list_min(sc))", "st": "[0.2::DOUBLE * (cc[c + 1] - least(greatest(sc[c + 1], lo2[c + 1]), hi2[c + 1])) FOR c IN range(5)]"},
]
_five = "[0.0::DOUBLE FOR c IN range(5)]"
register("csoaa_plain_online", _csoaa, fold_sql(f"{_TYPED}, {_ALL}", {"w": (_start(5), _moved("st")), "lo": (_five, "lo2"), "hi": (_five, "hi2")}, _cs, "user_id, event_id, round(CAST(p AS DOUBLE), 6) AS p"))

# Offset tree of five actions: inner nodes (0,1), (2,3), (those two), (that, 4); a slot for each side of each.
_PATHS = [[(0, 0), (2, 0), (3, 0)], [(0, 1), (2, 0), (3, 0)], [(1, 0), (2, 1), (3, 0)], [(1, 1), (2, 1), (3, 0)], [(3, 1)]]


def _climb(expr) -> str:
    """A case for each logged action, of a product over some nodes of its path."""
    return "CASE " + " ".join(f"WHEN a = {k} THEN {expr(path)}" for k, path in enumerate(_PATHS)) + " END"


def _side(scores: str, node: int, side: int) -> str:
    first, second = f"{scores}[{2 * node + 1}]", f"{scores}[{2 * node + 2}]"
    return f"(0.025::DOUBLE + 0.95::DOUBLE * CASE WHEN ({second} < {first}) = {'true' if side else 'false'} THEN 1 ELSE 0 END)"


def _product(scores: str, path) -> str:
    return " * ".join(_side(scores, n, s) for n, s in path) or "1.0::DOUBLE"


_wanted = "[" + ", ".join("CASE " + " ".join(f"WHEN a = {k} THEN {f'cost / lp' if side == 0 + s else '0.0'}" for k, path in enumerate(_PATHS) for m, s in path if m == n) + " END" for n in range(4) for side in range(2)) + "]"
_offset: list[dict[str, str]] = [{"sc": f"[{_score('c')} FOR c IN range(8)]", "want": _wanted}, {"lo2": "[least(lo[c + 1], coalesce(want[c + 1], lo[c + 1])) FOR c IN range(8)]", "hi2": "[greatest(hi[c + 1], coalesce(want[c + 1], hi[c + 1])) FOR c IN range(8)]"}]
_offset.append({"dir": "[coalesce(0.2::DOUBLE * (want[c + 1] - least(greatest(sc[c + 1], lo2[c + 1]), hi2[c + 1])), 0.0) FOR c IN range(8)]"})
# The weight that reaches a node is the product of the sides below it, each after its own step.
_offset.append({"k0": "1.0::DOUBLE"})
for _level in range(3):
    _node = lambda path, level=_level: path[level] if level < len(path) else None
    _offset.append({f"sn{_level}": f"[sc[c + 1] + 2 * k{_level} * dir[c + 1] FOR c IN range(8)]"})
    _offset.append({f"k{_level + 1}": f"k{_level} * " + _climb(lambda path, level=_level: _side(f"sn{level}", *path[level]) if level < len(path) else "1.0::DOUBLE")})
_offset.append({"st": "[" + ", ".join("CASE " + " ".join(f"WHEN a = {k} THEN k{path.index((n, s))} * dir[{2 * n + side + 1}]" for k, path in enumerate(_PATHS) for m, s in path if m == n) + " ELSE 0.0 END" for n in range(4) for side in range(2)) + "]"})


def _offset_tree(spark, sf):
    def run(rows):
        tree = events.OffsetTree(5, bits=5, make=composed.plain())
        out = []
        for x in rows:
            idx = np.array([x["k"] % 16, 16 + int(x["cost"] * COST_SCALE // 25) % 16], np.int64)
            out.append({"event_id": x["event_id"], "p": round(float(tree.learn(idx, np.ones(2), x["a"], x["cost"], x["p"])[x["a"]]), 6)})
        return out

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("p", pa.float64())])


_eight = "[0.0::DOUBLE FOR c IN range(8)]"
register(
    "offset_tree_plain", _offset_tree,
    fold_sql("k % 16 AS i1, 16 + CAST(floor(cost * 487.0::DOUBLE / 25) AS INTEGER) % 16 AS i2, a, cost, p AS lp", {"w": (_start(8), _moved("st")), "lo": (_eight, "lo2"), "hi": (_eight, "hi2")}, _offset, f"event_id, round({_climb(lambda path: _product('sc', path))}, 6) AS p"),
)


# --- confidence: distance from the threshold over sensitivity -------------------------------------


def _confidence(spark, sf):
    out = online.train(_stream(spark, sf), online.Run(lambda: asking.Confidence(bits=1, make=lambda bits, loss: online.GD(loss=loss, bits=bits, normalized=False, invariant=False))), ["user_id"]).where("kind = 'prediction'")
    return out.select(F.col("seq").alias("event_id"), r("p", 5).alias("confidence"))


register(
    "confidence_fold", _confidence,
    fold_sql("x, y", {"u": (D0, "u - 0.5::DOUBLE * sl * x / sqrt(greatest(gu2, 1e-300))"), "v": (D0, "v - 0.5::DOUBLE * sl / sqrt(greatest(gv2, 1e-300))"), "gu": (D0, "gu2"), "gv": (D0, "gv2")},
             [{"p": "least(greatest(u * x + v, -50), 50)"}, {"sl": _SLOPE}, {"gu2": "gu + sl * sl * greatest(x * x, 1.17549435e-38::DOUBLE)", "gv2": "gv + sl * sl"}, {"sens": "x * x / sqrt(greatest(gu, 1e-300)) + 1 / sqrt(greatest(gv, 1e-300))"}],
             "event_id, round(abs(p) / sens, 5) AS confidence"),
)


# --- slots, and stacks of options -----------------------------------------------------------------


def _slot_levels(pools: list[list[int]] | None) -> tuple[list[dict[str, str]], str]:
    """Two slots an event: the distribution of each before its step, then the step of what was logged."""
    per = [len(p) for p in pools] if pools else [5, 4]
    levels, w = [], "w"
    for s in range(2):
        mine = f"{pools[s]}" if pools else ("[0, 1, 2, 3, 4]" if s == 0 else "[j FOR j IN range(5) IF j <> t0]")
        levels.append({f"in{s}": mine, f"t{s}": (f"a % {len(pools[s])} + {pools[s][0]}" if pools else ("a" if s == 0 else "(a + 1) % 5"))})
        levels.append({f"cs{s}": f"[{w}[j + 1] + 0.5::DOUBLE * {w}[sh + 1] + {w}[own[j + 1] + 1] + {w}[{60 + s + 1}] FOR j IN in{s}]"})
        levels.append({f"q{s}": f"0.05::DOUBLE / {per[s]} + 0.95::DOUBLE * CASE WHEN cs{s}[list_position(in{s}, t{s})] = list_min(cs{s}) THEN 1 ELSE 0 END / len(list_filter(cs{s}, lambda z: z = list_min(cs{s})))"})
        seen = f"({sum(per)} * (n - 1) + {sum(per[: s + 1])})"
        more, w = _step_level(s, w, f"t{s}", "cost" if pools or s == 0 else "1 - cost", f"1 / lp * (2 * n - {1 - s}) / {seen}", extra=60 + s)
        levels += more
    return levels, w


def _slots(name: str, pools: list[list[int]] | None) -> None:
    def query(spark, sf):
        def run(rows):
            policy, out = composed.Policy(bits=6, make=composed.plain()), []
            slots = [(np.array([60 + s], np.int64), np.ones(1)) for s in range(2)]
            for x in rows:
                taken = [pools[s][0] + x["a"] % len(pools[s]) for s in range(2)] if pools else [x["a"], (x["a"] + 1) % 5]
                outcomes = [{"action": taken[s], "cost": x["cost"] if pools or s == 0 else 1 - x["cost"], "p": x["p"]} for s in range(2)]
                got = events.learn_slots(policy, _actions(x), slots, outcomes, pools)
                mine = [pools[0] if pools else list(range(5)), pools[1] if pools else [j for j in range(5) if j != taken[0]]]
                out.append({"event_id": x["event_id"], "p0": round(float(got[0][2][mine[0].index(taken[0])]), 5), "p1": round(float(got[1][2][mine[1].index(taken[1])]), 5)})
            return out

        return _bandit(spark, sf, run, [("event_id", pa.int64()), ("p0", pa.float64()), ("p1", pa.float64())])

    levels, last = _slot_levels(pools)
    register(name, query, fold_sql(_CB, {"w": (_wide_start(), last), "w_lo": (D0, "w_lo2"), "w_hi": (D0, "w_hi2")}, levels, "event_id, round(q0, 5) AS p0, round(q1, 5) AS p1"))


_slots("ccb_plain_online", None)
_slots("slates_plain_online", [[0, 1, 2], [3, 4]])

_PLAIN = "--sgd -l 0.1 --power_t 0 --noconstant -b 14"


def _named_actions(spark, sf):
    """The same actions as ``_actions`` has, by name."""
    own = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.array(features.feature("a", F.concat(F.lit("j"), j)), features.feature("o", F.concat_ws("_", j, F.col("k") % 8))))
    return log(spark, sf).select("user_id", F.col("event_id").alias("seq"), F.array(features.feature("s", F.concat(F.lit("k"), F.col("k") % 8), 0.5)).alias("shared"), own.alias("actions"), F.col("a").alias("chosen"), "cost", "p", action_costs().alias("costs"))


def _stacked(name: str, options: str, like: str, column: str) -> None:
    """A stack's training on named features against the SQL of the same learner on numbered ones."""

    def query(spark, sf):
        rows = _named_actions(spark, sf)
        out = Stack.parse(f"{options} {_PLAIN}").fit_events(rows, ["user_id"])
        if column == "best":
            return out.select(F.col("seq").alias("event_id"), F.col("best").cast("long").alias("best"))
        return out.join(rows.select("seq", "chosen"), "seq").select(F.col("seq").alias("event_id"), r(F.get("pmf", F.col("chosen")), 5).alias("p"))

    register(name, query, ORACLE_SQL[like])


_stacked("stack_cb_explore_adf", "--cb_explore_adf --epsilon 0.05 --cb_type mtr", "cb_adf_mtr_epsilon_plain", "p")
_stacked("stack_cb_softmax", "--cb_explore_adf --softmax --lambda 1 --cb_type ips", "cb_adf_ips_softmax_plain", "p")
_stacked("stack_cb_squarecb", "--cb_explore_adf --squarecb --gamma_scale 10 --cb_type ips", "cb_adf_ips_squarecb_plain", "p")
_stacked("stack_cb_first", "--cb_explore_adf --first 10 --cb_type dr", "cb_adf_dr_first_plain", "p")
_stacked("stack_cb_sm", "--cb_explore_adf --softmax --cb_type sm", "cb_adf_sm_plain", "p")
_stacked("stack_csoaa_ldf", "--csoaa_ldf --csoaa_type oaa", "csoaa_ldf_plain", "best")
_stacked("stack_csoaa_ldf_mc", "--csoaa_ldf --csoaa_type mc", "csoaa_ldf_mc_plain", "best")
_stacked("stack_wap_ldf", "--wap_ldf", "wap_ldf_plain", "best")


def _stacked_classes(name: str, options: str, like: str, label) -> None:
    def query(spark, sf):
        typed = _typed(spark, sf).drop("idx", "val").join(log(spark, sf).select(F.col("event_id").alias("seq"), "k", "value", action_costs().alias("costs")), "seq")
        f = F.array(features.feature("u", F.concat(F.lit("k"), F.col("k") % 16)), features.feature("v", F.concat(F.lit("b"), F.floor(F.col("value") / 25) % 16)))
        rows = typed.select("user_id", "seq", "weight", f.alias("features"), F.expr(label).alias("y"))
        out = Stack.parse(f"{options} {_PLAIN}").fit(rows, ["user_id"]).predictions
        return out.select("user_id", F.col("seq").alias("event_id"), r("p").alias("p"))

    register(name, query, ORACLE_SQL[like])


_stacked_classes("stack_oaa", "--oaa 5", "oaa_plain_online", "y")
_stacked_classes("stack_boosting", "--boosting 3", "boosting_plain_online", "CASE WHEN y = 1 THEN 1D ELSE -1D END")
_stacked_classes("stack_csoaa", "--csoaa 5", "csoaa_plain_online", "costs")
_stacked_classes("stack_plt", "--plt 4", "plt_plain_online", "y % 4")


# --- more losses and options of plain descent ------------------------------------------------------


def _sgd(name: str, slope: str, loss: str, bound: str = "u * x + v", before: dict | None = None, label: str = "y", **more) -> None:
    """Plain descent with a loss: ``bound`` is the prediction, ``before`` levels that it needs."""
    state = {"u": (D0, "u - 0.1::DOUBLE * sl * x"), "v": (D0, "v - 0.1::DOUBLE * sl")} | more.pop("state", {})

    def run(spark, sf):
        rows = _stream(spark, sf).withColumn("y", F.expr(label))
        make = lambda: online.GD(**({"loss": loss, "rate": 0.1, "power": 0.0, "adaptive": False, "normalized": False, "invariant": False, "bits": 1, "tau": 0.3} | more))
        out = online.train(rows, online.Run(make), ["user_id"]).where("kind = 'prediction'")
        return out.select(F.col("seq").alias("event_id"), (r("p") + 0.0).alias("p"))

    register(name, run, fold_sql(f"x, {label.replace('D', '::DOUBLE')} AS y" if label != "y" else "x, y", state, [*([before] if before else []), {"p": bound}, {"sl": slope}], "event_id, round(p, 6) + 0.0 AS p"))


_wide = "least(greatest(u * x + v, -50), 50)"
_seen = {"state": {"lo": (D0, "lo2"), "hi": (D0, "hi2")}, "before": {"lo2": "least(lo, y)", "hi2": "greatest(hi, y)"}}
_sgd("sgd_hinge_fold", "CASE WHEN y * p < 1 THEN -y ELSE 0 END", "hinge", _wide)
_sgd("sgd_quantile_fold", "CASE WHEN y > p THEN -0.3::DOUBLE WHEN y < p THEN 0.7::DOUBLE ELSE 0 END", "pinball", _wide)
_sgd("sgd_expectile_fold", "2 * CASE WHEN y > p THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END * (p - y)", "expectile", _wide)
_sgd("sgd_poisson_fold", "2 * (exp(least(p, 44)) - y)", "poisson", _wide, label="y + 2")
_sgd("sgd_squared_fold", "2 * (p - y)", "squared", "least(greatest(u * x + v, lo2), hi2)", **_seen)
_sgd("sgd_power_fold", "-y / (1 + exp(y * p)) / sqrt(n + 2)", "logistic", _wide, power=0.5, initial_t=2.0)
_sgd("sgd_l2_fold", "-y / (1 + exp(y * p))", "logistic", _wide, l2=0.05, state={"u": (D0, "u * (1 - 0.005::DOUBLE) - 0.1::DOUBLE * sl * x"), "v": (D0, "v * (1 - 0.005::DOUBLE) - 0.1::DOUBLE * sl")})
_sgd("sgd_l1_fold", "-y / (1 + exp(y * p))", "logistic", "least(greatest(sign(u) * greatest(abs(u) - 0.005::DOUBLE, 0) * x + sign(v) * greatest(abs(v) - 0.005::DOUBLE, 0), -50), 50)", l1=0.05)

_dense("binary_plain_fold", lambda: composed.Signed(online.GD(loss="logistic", rate=0.1, power=0.0, adaptive=False, normalized=False, invariant=False, bits=1)),
       {"u": (D0, "u - 0.1::DOUBLE * sl * x"), "v": (D0, "v - 0.1::DOUBLE * sl")}, [{"raw": _wide}, {"p": "CASE WHEN raw > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END", "sl": "-y / (1 + exp(y * raw))"}])

# Zeroth-order steps of a continuous action: cost (1) over the distance of the logged action.
_dense("cbzo_plain_fold", lambda: composed.ZerothOrder(rate=0.01, low=-5, high=5, bits=1),
       {"u": (D0, "u - 0.01::DOUBLE / gap * x"), "v": (D0, "v - 0.01::DOUBLE / gap")}, [{"p": "least(greatest(u * x + v, -5), 5)"}, {"gap": "CASE WHEN y - p < 0 THEN -1 ELSE 1 END * greatest(abs(y - p), 1e-6)"}])

# Active learning: the generator's n-th draw against the probability that the label could matter.
_room = "(8 * ln(t + 1) / t)"
_active_q = f"CASE WHEN t < 2 OR gap <= sqrt({_room}) + {_room} THEN 1.0::DOUBLE ELSE least(1, greatest(pow(({_room} + sqrt({_room} * {_room} + 4 * gap * gap * {_room})) / (2 * gap * gap), 2), 1e-4)) END"
_dense(
    "active_plain_fold", lambda: composed.Active(bits=1, make=composed.plain()),
    {"u": (D0, "u - CASE WHEN draw < q THEN 0.1::DOUBLE / q * sl * x ELSE 0 END"), "v": (D0, "v - CASE WHEN draw < q THEN 0.1::DOUBLE / q * sl ELSE 0 END"), "st": ("0::UHUGEINT", "st2")},
    [
        {"p": _wide, "t": "n", "st2": f"(st * {Merand48.A}::UHUGEINT + 2147483647::UHUGEINT) % 18446744073709551616::UHUGEINT"},
        {"sl": "-y / (1 + exp(y * p))", "draw": "CAST((st2 // 33554432::UHUGEINT) % 8388608::UHUGEINT AS DOUBLE) / 8388608", "gap": "abs(p) / ((x * x + 1) * t)"},
        {"q": _active_q},
    ],
)

_multilabel = [
    {"sc": f"[{_score('c')} FOR c IN range(5)]"},
    {"p": "coalesce(list_sum([CASE WHEN sc[c + 1] > 0 THEN pow(2, c) ELSE 0 END FOR c IN range(5)]), 0)", "st": f"[{_logistic_step('(CASE WHEN c + 1 = y OR c = y % 5 THEN 1 ELSE -1 END)', 'sc[c + 1]')} FOR c IN range(5)]"},
]


def _multilabels(spark, sf):
    rows = _typed(spark, sf).withColumn("y", F.array(F.col("y").cast("int"), (F.col("y") % 5 + 1).cast("int")))
    out = online.train(rows, online.Run(lambda: composed.MultilabelOneAgainstAll(classes=5, bits=5, make=composed.plain())), ["user_id"]).where("kind = 'prediction'")
    return out.select("user_id", F.col("seq").alias("event_id"), r("p").alias("p"))


register("multilabel_plain_online", _multilabels, fold_sql(_TYPED, {"w": (_start(5), _moved("st"))}, _multilabel, "user_id, event_id, round(CAST(p AS DOUBLE), 6) AS p"))


# --- factor models: first factors by a rule --------------------------------------------------------


def _ruled(rows: int, columns: int):
    return ((np.arange(rows * columns) * 7 % 11 - 5) / 50.0).reshape(rows, columns)


def _vectors(count: int) -> str:
    return f"[(i * 7 % 11 - 5) / 50.0::DOUBLE FOR i IN range({count})]"


def _factor(name: str, make, state, levels, third: bool = False) -> None:
    def run(spark, sf):
        rows = _typed(spark, sf).withColumn("y", F.col("y") / 5)
        if third:
            rows = rows.withColumn("idx", F.concat("idx", F.array((32 + F.col("seq") % 8).cast("long")))).withColumn("val", F.expr("array(1D, 1D, 1D)"))
        out = online.train(rows, online.Run(make), ["user_id"]).where("kind = 'prediction'")
        return out.select("user_id", F.col("seq").alias("event_id"), r("p", 5).alias("p"))

    register(name, run, fold_sql(f"{_TYPED}, CAST(32 + event_id % 8 AS INTEGER) AS i3", state, levels, "user_id, event_id, round(p, 5) AS p"))


_near = "y / 5.0::DOUBLE"
_dot = "list_sum([{v}[i1 * 2 + k + 1] * {v}[i2 * 2 + k + 1] FOR k IN range(2)])"
_line = "list_transform(w, lambda z, j: CASE WHEN j - 1 = i1 OR j - 1 = i2 THEN z + {} ELSE z END)"
_both = "list_transform(v, lambda z, j: CASE WHEN (j - 1) // 2 = i1 THEN z + {0} * v[i2 * 2 + (j - 1) % 2 + 1] WHEN (j - 1) // 2 = i2 THEN z + {0} * v[i1 * 2 + (j - 1) % 2 + 1] ELSE z END)"
_factor("mf_plain_online", lambda: online.Factors(rank=2, split=16, bits=5, start=_ruled), {"w": (_start(1), _line.format("d")), "v": (_vectors(64), _both.format("d"))}, [{"p": f"w[i1 + 1] + w[i2 + 1] + {_dot.format(v='v')}"}, {"d": f"0.1::DOUBLE * ({_near} - p)"}])

_one_side = "list_transform({v}, lambda z, j: CASE WHEN (j - 1) // 2 = {a} THEN z + {d} * {v}[{b} * 2 + (j - 1) % 2 + 1] ELSE z END)"
_factor(
    "split_factors_plain_online", lambda: factors.SplitFactors(rank=2, split=16, bits=5, start=_ruled), {"w": (_start(1), "w2"), "v": (_vectors(64), "v2")},
    [
        {"p": f"w[i1 + 1] + w[i2 + 1] + {_dot.format(v='v')}"},
        {"w2": _line.format(f"0.1::DOUBLE * ({_near} - p)")},
        {"d1": f"0.1::DOUBLE * ({_near} - w2[i1 + 1] - w2[i2 + 1] - {_dot.format(v='v')})"},
        {"v1": _one_side.format(v="v", a="i1", b="i2", d="d1")},
        {"d2": f"0.1::DOUBLE * ({_near} - w2[i1 + 1] - w2[i2 + 1] - {_dot.format(v='v1')})"},
        {"v2": _one_side.format(v="v1", a="i2", b="i1", d="d2")},
    ],
)

# Field-aware: three fields, each feature with two weights for each field.
_at = lambda i, f: f"({i} * 6 + {f} * 2 + k + 1)"
_meet = " + ".join(f"list_sum([v[{_at(f'i{a + 1}', b)}] * v[{_at(f'i{b + 1}', a)}] FOR k IN range(2)])" for a, b in ((0, 1), (0, 2), (1, 2)))
_moves = " ".join(f"WHEN (j - 1) // 6 = i{a + 1} AND (j - 1) % 6 // 2 = {b} THEN z + d * v[i{b + 1} * 6 + {a} * 2 + (j - 1) % 2 + 1]" for a in range(3) for b in range(3) if a != b)
_factor(
    "field_factors_plain_online", lambda: factors.FieldFactors(bounds=(16, 32), rank=2, bits=6, start=_ruled),
    {"w": (_start(2), "list_transform(w, lambda z, j: CASE WHEN j - 1 = i1 OR j - 1 = i2 OR j - 1 = i3 THEN z + d ELSE z END)"), "v": (_vectors(384), f"list_transform(v, lambda z, j: CASE {_moves} ELSE z END)")},
    [{"p": f"w[i1 + 1] + w[i2 + 1] + w[i3 + 1] + {_meet}"}, {"d": f"0.1::DOUBLE * ({_near} - p)"}], third=True,
)


# --- a challenged baseline; continuous actions; supervised rows as bandits --------------------------


def _rounded(x: float, places: int) -> float:
    """``x`` rounded as SQL does it, halves of the scaled number away from zero."""
    scaled = x * 10.0**places
    if not math.isfinite(scaled):
        return x
    whole = math.trunc(scaled)
    return math.copysign((abs(whole) + (abs(scaled - whole) >= 0.5)) / 10.0**places, x)


def _challenged(spark, sf):
    def run(rows):
        learner = events.BaselineChallenger(composed.Policy(bits=6, make=composed.plain()), lambda stats: -1e9, tau=0.9)
        out = []
        for x in rows:
            best, mean, n = learner.learn(_actions(x), x["a"], x["cost"], x["p"])
            out.append({"event_id": x["event_id"], "best": best, "mean": _rounded(mean, 5), "n": _rounded(n, 5), "base_w": _rounded(learner.stats["w"], 5), "base_wr": _rounded(learner.stats["wr"], 5)})
        return out

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("best", pa.int64()), ("mean", pa.float64()), ("n", pa.float64()), ("base_w", pa.float64()), ("base_wr", pa.float64())])


_more, _w = _step_level(0, "w", "a", "cost", "1 / lp / 5")
_fading = {k: (D0, f"{k}2") for k in ("tot", "cnt", "bw", "bwr")}
register(
    "baseline_challenger_plain", _challenged,
    fold_sql(
        _CB, {"w": (_wide_start(), _w), "w_lo": (D0, "w_lo1"), "w_hi": (D0, "w_hi1")} | _fading,
        [{"cs": _costs()}, {"best": "list_position(cs, list_min(cs)) - 1"}, {"pw": "CASE WHEN a = best THEN 1 / lp ELSE 0 END", "zw": "CASE WHEN a = 0 THEN 1 / lp ELSE 0 END"},
         {"tot2": "0.9::DOUBLE * tot - pw * cost", "cnt2": "0.9::DOUBLE * cnt + pw", "bw2": "0.9::DOUBLE * bw + zw", "bwr2": "0.9::DOUBLE * bwr - zw * cost"}, *_more],
        "event_id, best, round(CASE WHEN cnt2 = 0 THEN 0 ELSE tot2 / cnt2 END, 5) AS mean, round(cnt2, 5) AS n, round(bw2, 5) AS base_w, round(bwr2, 5) AS base_wr",
    ),
)


def _pdf(spark, sf):
    return log(spark, sf).select("event_id", F.posexplode(E.continuous_policy(F.col("k") % 8, 8, 0.0, 16.0, 1, 0.1)).alias("bin", "s")).select("event_id", F.col("bin").cast("long").alias("bin"), r("s.left").alias("left"), r("s.right").alias("right"), r("s.density").alias("density"))


register("cats_pdf", _pdf, f"WITH {LOG_SQL} SELECT event_id, b AS bin, 2.0::DOUBLE * b AS left, 2.0::DOUBLE * b + 2 AS right, round(0.1 / 16 + CASE WHEN abs(b - k % 8) <= 1 THEN 0.9 / 2 / (least(k % 8 + 1, 7) - greatest(k % 8 - 1, 0) + 1) ELSE 0 END, 6) AS density FROM log, (SELECT unnest(range(8)) AS b)")


def _spread(spark, sf):
    q = (F.col("k") % 4) / 4.0
    return log(spark, sf).select("event_id", F.posexplode(E.spread_pmf(F.array(q, F.lit(0.0), 1 - q, F.lit(0.0)), 0.0, 1.0, 1)).alias("bin", "s")).select("event_id", F.col("bin").cast("long").alias("bin"), r("s.density").alias("density"))


register("pmf_to_pdf_bins", _spread, f"WITH {LOG_SQL}, q AS (SELECT event_id, (k % 4) / 4.0::DOUBLE AS q FROM log) SELECT event_id, b AS bin, round(4 * CASE b WHEN 0 THEN q / 2 WHEN 1 THEN q / 2 + (1 - q) / 3 ELSE (1 - q) / 3 END, 6) AS density FROM q, (SELECT unnest(range(4)) AS b)")

_DRAW = "(event_id * 37 % 100 + 0.5) / 100.0"
_DRAWN = "SELECT *, CASE WHEN draw < 0.02 + CASE WHEN best = 0 THEN 0.9 ELSE 0 END THEN 0 WHEN draw < 0.04 + CASE WHEN best <= 1 THEN 0.9 ELSE 0 END THEN 1 WHEN draw < 0.06 + CASE WHEN best <= 2 THEN 0.9 ELSE 0 END THEN 2 WHEN draw < 0.08 + CASE WHEN best <= 3 THEN 0.9 ELSE 0 END THEN 3 ELSE 4 END AS chosen FROM b"


def _scores(j: str) -> str:
    return f"((k * 3 + {j} * 29) % 53) / 53.0"


def _cbify_costs(spark, sf):
    e = log(spark, sf).withColumn("costs", action_costs()).withColumn("scores", F.array(*[F.expr(_scores(str(j))) for j in range(5)]))
    out = simulation.cbify_costs(e, F.col("costs"), X.epsilon_greedy(F.col("scores"), 0.1), F.expr(_DRAW))
    return out.select("event_id", F.col("chosen").cast("long").alias("chosen"), r("p").alias("p"), r("cost").alias("cost"))


_best = f"list_position([{', '.join(_scores(str(j)) for j in range(5))}], list_min([{', '.join(_scores(str(j)) for j in range(5))}])) - 1"
register("cbify_costs_logged", _cbify_costs, f"WITH {LOG_SQL}, b AS (SELECT event_id, k, {_DRAW} AS draw, {_best} AS best FROM log), d AS ({_DRAWN}) SELECT event_id, chosen, CASE WHEN chosen = best THEN 0.92::DOUBLE ELSE 0.02::DOUBLE END AS p, round(CAST(((k * (7 * (chosen + 3)) + event_id * (13 * (chosen + 1))) % 101) / 100.0 AS DOUBLE), 6) AS cost FROM d")


def _cbify_regression(spark, sf):
    e = log(spark, sf).withColumn("scores", F.array(*[F.expr(_scores(str(j))) for j in range(5)]))
    out = simulation.cbify_regression(e, F.col("x"), 5, -2.0, 2.0, X.epsilon_greedy(F.col("scores"), 0.1), F.expr(_DRAW))
    return out.select("event_id", F.col("chosen").cast("long").alias("chosen"), r("cost").alias("cost"))


register("cbify_regression_logged", _cbify_regression, f"WITH {LOG_SQL}, b AS (SELECT event_id, k, x, {_DRAW} AS draw, {_best} AS best FROM log), d AS ({_DRAWN}) SELECT event_id, chosen, round((x - (-2 + (chosen + 0.5) * 0.8)) * (x - (-2 + (chosen + 0.5) * 0.8)) / 16, 6) AS cost FROM d")


# Bootstrap: three replicas see an example a Poisson(1) number of times, from one generator in turn.
_next = lambda s: f"({s} * {Merand48.A}::UHUGEINT + 2147483647::UHUGEINT) % 18446744073709551616::UHUGEINT"
_below_sums = "[" + ", ".join(f"{sum(1 / math.factorial(j) for j in range(k + 1)) * math.exp(-1)!r}::DOUBLE" for k in range(12)) + "]"
_boot: list[dict[str, str]] = [{"sc": f"[{_score('c')} FOR c IN range(3)]", "yy": "CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END", "s1": _next("st")}, {"s2": _next("s1")}, {"s3": _next("s2")}]
_boot += [{"times": "[len(list_filter(" + _below_sums + ", lambda z: CAST((q // 33554432::UHUGEINT) % 8388608::UHUGEINT AS DOUBLE) / 8388608 > z)) FOR q IN [s1, s2, s3]]"}]
_boot += [{"p": "list_sum([greatest(least(z, 50), -50) FOR z IN sc]) / 3", "step": f"[times[c + 1] * {_logistic_step('yy', 'sc[c + 1]')} FOR c IN range(3)]"}]


def _bootstrapped(spark, sf):
    rows = _typed(spark, sf).withColumn("y", F.when(F.col("y") == 1, 1.0).otherwise(-1.0))
    out = online.train(rows, online.Run(lambda: composed.Bootstrap(replicas=3, loss="logistic", bits=5, make=composed.plain())), ["user_id"]).where("kind = 'prediction'")
    return out.select("user_id", F.col("seq").alias("event_id"), r("p", 5).alias("p"))


register("bootstrap_plain_online", _bootstrapped, fold_sql(_TYPED, {"w": (_start(3), _moved("step")), "st": ("0::UHUGEINT", "s3")}, _boot, "user_id, event_id, round(p, 5) AS p"))

# Continuous actions by a tree of eight bins: seven nodes of sixteen weights, learnt from the leaves up.
_cats: list[dict[str, str]] = [
    {"bin": "least(greatest(CAST(floor(k / 100.0::DOUBLE * 8) AS INTEGER), 0), 7)", "sc": "[w[m * 16 + i1 + 1] FOR m IN range(7)]"},
    {"lo": "greatest(bin - 1, 0)", "hi": "least(bin + 1, 7)"},
    {"up3": "[CASE WHEN m BETWEEN lo AND hi THEN cost / greatest(lp * 0.125::DOUBLE * (hi - lo + 1), 1e-6) ELSE 0.0::DOUBLE END FOR m IN range(8)]"},
]
for _level, _first in ((2, 3), (1, 1), (0, 0)):
    _below, _count = f"up{_level + 1}", 1 << _level
    _y = f"(CASE WHEN {_below}[2 * m + 2] < {_below}[2 * m + 1] THEN 1 ELSE -1 END)"
    _cats += [
        {f"st{_level}": f"[0.1::DOUBLE * abs({_below}[2 * m + 1] - {_below}[2 * m + 2]) * ({_y} / (1 + exp({_y} * sc[m + {_first} + 1]))) FOR m IN range({_count})]"},
        {f"up{_level}": f"[CASE WHEN sc[m + {_first} + 1] + st{_level}[m + 1] > 0 THEN {_below}[2 * m + 2] ELSE {_below}[2 * m + 1] END FOR m IN range({_count})]"},
    ]
_cats += [{"st": "list_concat(st0, list_concat(st1, st2))", "n1": "CASE WHEN sc[1] > 0 THEN 2 ELSE 1 END"}, {"n2": "2 * n1 + CASE WHEN sc[n1 + 1] > 0 THEN 2 ELSE 1 END"}, {"n3": "2 * n2 + CASE WHEN sc[n2 + 1] > 0 THEN 2 ELSE 1 END"}]


def _cats_tree(spark, sf):
    def run(rows):
        tree = composed.CatsTree(bins=8, bits=4, make=composed.plain())
        return [{"event_id": x["event_id"], "p": round(float(tree.learn_logged(np.array([x["k"] % 16], np.int64), np.ones(1), x["k"] / 100, x["cost"], x["p"])), 6)} for x in rows]

    return _bandit(spark, sf, run, [("event_id", pa.int64()), ("p", pa.float64())])


register(
    "cats_tree_plain", _cats_tree,
    fold_sql("k, cost, p AS lp, k % 16 AS i1", {"w": ("list_transform(range(112), lambda z: 0.0::DOUBLE)", "list_transform(w, lambda z, j: CASE WHEN (j - 1) % 16 = i1 THEN z + st[(j - 1) // 16 + 1] ELSE z END)")}, _cats, "event_id, round((n3 - 7 + 0.5) / 8, 6) AS p"),
)

__all__ = ["QUERIES"]
