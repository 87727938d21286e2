"""Options to a plan: which reductions stand on which, with those that an option implies.

``Stack.parse("--cb_explore_adf --epsilon 0.1 -q ab")`` gives an ordered list of layers that
``explain`` prints, and that ``fit`` (examples) or ``fit_events`` (events of several actions) train.
An unknown option is an error, and so is one that the stack has no use for.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from ..functions import text as T
from ..operators import asking, batch, composed, events, features, online
from ..operators.online import Kernel, Run, hashed, train

#: Options that make a layer, from the top of a stack down, with the layers each needs below it.
LAYERS: dict[str, tuple[str, ...]] = {
    "slates": ("ccb_explore_adf",), "ccb_explore_adf": ("cb_explore_adf",), "cb_explore_adf": ("cb_adf",), "cb_adf": ("csoaa_ldf",), "csoaa_ldf": (), "wap_ldf": (), "ot": (), "cb_explore": ("cb",), "cb": ("csoaa",), "csoaa": (),
    "cats_tree": (), "cbzo": (), "plt": (), "oaa": (), "ect": (), "log_multi": (), "memory_tree": (), "multilabel_oaa": (), "boosting": (), "bootstrap": (),
    "active": (), "active_cover": (), "cs_active": (), "confidence": (), "replay": (), "baseline": (), "binary": (),
}
#: Layers whose events have several actions.
EVENTS = ("slates", "ccb_explore_adf", "cb_explore_adf", "cb_adf", "csoaa_ldf", "wap_ldf", "cb_explore", "cb", "ot")
#: Layers that are named together with a number of classes, learners or bins.
NUMBERED = ("cb_explore", "cb", "csoaa", "cats_tree", "plt", "oaa", "ect", "log_multi", "memory_tree", "multilabel_oaa", "boosting", "bootstrap", "cs_active", "replay", "ot")
BASES = ("gd", "ftrl", "pistol", "coin", "freegrad", "svrg", "nn", "mf", "ksvm", "OjaNewton", "noop", "bfgs")
SHORT = {"quadratic": "q", "bit_precision": "b", "learning_rate": "l", "initial_t": "initial_t", "lambda_": "lambda"}
FEATURES = ("q", "cubic", "interactions", "experimental_full_name_interactions", "ngram", "skips", "affix", "spelling", "ignore", "ignore_linear", "keep", "feature_limit", "noconstant", "leave_duplicate_interactions", "permutations")
VALUES = (
    *FEATURES[:-3], "quadratic", "b", "bit_precision", "l", "learning_rate", "power_t", "initial_t", "decay_learning_rate", "l1", "l2", "passes", "loss_function", "epsilon", "gamma_scale", "lambda", "bag", "cover", "psi", "first", "cb_type", "csoaa_type", "clip_p", "holdout_period", "holdout_after", "early_terminate",
    "quantile_tau", "link", "rank", "ftrl_alpha", "ftrl_beta", "random_seed", "mellowness", "gamma", "classweight", "mem", "min_value", "max_value", "bandwidth",
)
FLAGS = ("noconstant", "sgd", "adaptive", "normalized", "invariant", "squarecb", "softmax", "holdout_off", "leave_duplicate_interactions", "permutations", "save_per_pass")


@dataclass
class Stack:
    layers: list[tuple[str, str | None]] = field(default_factory=list)
    base: str = "gd"
    options: dict[str, list[str]] = field(default_factory=dict)
    used: set[str] = field(default_factory=set)

    @classmethod
    def parse(cls, command: str) -> Stack:
        out, words = cls(), shlex.split(command)
        k = 0
        while k < len(words):
            word = words[k]
            if not word.startswith("-"):
                raise ValueError(f"a value without an option: {word}")
            name, equals, value = word.lstrip("-").partition("=")
            takes = k + 1 < len(words) and not (words[k + 1].startswith("-") and not words[k + 1].lstrip("-").replace(".", "").replace("e-", "").isdigit())
            if name in LAYERS:
                takes = takes and name in NUMBERED
                out.layers.append((name, value if equals else words[k + 1] if takes else None))
                k += not equals and takes
            elif name in BASES:
                out.base = name
                if name == "nn" and takes:
                    out.options.setdefault("units", []).append(words[k + 1])
                    k += 1
            elif name in FLAGS:
                out.options[name] = []
            elif name in VALUES:
                if not equals and not takes:
                    raise ValueError(f"--{name} needs a value")
                out.options.setdefault(SHORT.get(name, name), []).append(value if equals else words[k + 1])
                k += not equals
            else:
                raise ValueError(f"unknown option --{name}")
            k += 1
        out._imply()
        return out

    def _imply(self) -> None:
        have = {name for name, _ in self.layers}
        queue = list(self.layers)
        while queue:
            name, value = queue.pop(0)
            for below in LAYERS[name]:
                if below not in have:
                    have.add(below)
                    self.layers.append((below, value))
                    queue.append((below, value))
        self.layers.sort(key=lambda x: list(LAYERS).index(x[0]))

    def has(self, name: str) -> bool:
        self.used.add(name)
        return name in self.options

    def all(self, name: str) -> list[str]:
        self.used.add(name)
        return self.options.get(name, [])

    def get(self, name: str, default: float) -> float:
        return float(x[-1]) if (x := self.all(name)) else default

    def word(self, name: str, default: str) -> str:
        return x[-1] if (x := self.all(name)) else default

    def check(self) -> None:
        if left := sorted(set(self.options) - self.used):
            raise ValueError(f"no use in this stack for {', '.join('--' + x for x in left)}")

    def explain(self) -> str:
        rows = [f"{name}{f' {value}' if value else ''}" for name, value in self.layers]
        return "\n".join("  " * i + x for i, x in enumerate([*rows, "scorer", self.base]))

    # --- features ---------------------------------------------------------------------------------

    def _spaces(self, df: DataFrame, column: Column) -> list[str]:
        """First characters of the namespaces, where an option speaks of all of them."""
        patterns = [p for name in ("q", "cubic", "interactions", "ngram", "skips", "feature_limit") for p in self.options.get(name, [])]
        if not any(":" in p or p.isdigit() for p in patterns):
            return []
        return sorted({r[0] for r in df.select(F.explode(F.array_distinct(F.transform(column, lambda x: F.left(x["ns"], F.lit(1)))))).distinct().collect()})

    def expression(self, f: Column, spaces: list[str]) -> Column:
        """The feature options as one array expression over an array of features."""
        whole = f
        for ns, n in _by_space(self.all("ngram"), spaces):
            skips = dict(_by_space(self.all("skips"), spaces)).get(ns, 0)
            grams = T.ngrams(F.transform(features.namespace(whole, ns), lambda x: x["name"]), n, skips)
            f = F.concat(f, features.bag_of(ns, grams))
        for spec in (s for value in self.all("affix") for s in value.split(",")):
            sign, rest = (-1, spec[1:]) if spec[0] == "-" else (1, spec.lstrip("+"))
            length, ns = int("".join(c for c in rest if c.isdigit())), "".join(c for c in rest if not c.isdigit())
            f = F.concat(f, features.bag_of(f"{ns}_affix{sign * length}", T.affix(F.transform(features.namespace(whole, ns), lambda x: x["name"]), sign * length)))
        for ns in (c for value in self.all("spelling") for c in value):
            f = F.concat(f, features.bag_of(f"{ns}_spelling", T.shape(F.transform(features.namespace(whole, ns), lambda x: x["name"]))))
        for c in self.all("ignore"):
            f, whole = features.ignore(f, *c), features.ignore(whole, *c)
        if keep := self.all("keep"):
            spaces_kept = [c for s in keep for c in s]
            f, whole = features.keep(f, *spaces_kept), features.keep(whole, *spaces_kept)
        for ns, n in _by_space(self.all("feature_limit"), spaces):
            f = F.concat(F.filter(f, lambda x, ns=ns: ~x["ns"].startswith(ns)), features.limit(features.namespace(f, ns), n))
        for c in self.all("ignore_linear"):
            f = features.ignore(f, *c)
        patterns = [p for name in ("q", "cubic", "interactions") for p in self.all(name)]
        permutations, duplicates = self.has("permutations"), self.has("leave_duplicate_interactions")
        if patterns:
            f = F.concat(f, *[features.interactions(whole, list(p), permutations) for p in features.expand_wildcards(patterns, spaces, duplicates)])
        for names in self.all("experimental_full_name_interactions"):
            f = F.concat(f, features.interactions(whole, names.split("|"), permutations))
        return f if self.has("noconstant") else features.constant(f)

    def features(self, df: DataFrame, column: str = "features") -> DataFrame:
        return df.withColumn(column, self.expression(F.col(column), self._spaces(df, F.col(column))))

    # --- learners ---------------------------------------------------------------------------------

    def maker(self) -> composed.Maker:
        """Makes the base learners of the stack: (bits, loss, bounds). A loss that is asked for goes before a layer's own."""
        asked, rate, seed = self.word("loss_function", ""), self.get("l", 0.5), int(self.get("random_seed", 0))
        tau = self.get("quantile_tau", 0.5)
        more = {}
        if self.base in ("gd",):
            picked = {x for x in ("adaptive", "normalized", "invariant") if self.has(x)}
            chosen = picked if picked or self.has("sgd") else {"adaptive", "normalized", "invariant"}
            more = {"rate": rate, "power": self.get("power_t", 0.5), "l1": self.get("l1", 0), "l2": self.get("l2", 0), "initial_t": self.get("initial_t", 0), "decay": self.get("decay_learning_rate", 1), "tau": tau}
            more |= {x: x in chosen for x in ("adaptive", "normalized", "invariant")}
            if self.has("min_value"):
                more["low"] = self.get("min_value", 0)
            if self.has("max_value"):
                more["high"] = self.get("max_value", 0)
        elif self.base == "ftrl":
            more = {"alpha": self.get("ftrl_alpha", 0.5), "beta": self.get("ftrl_beta", 1.0), "l1": self.get("l1", 0), "l2": self.get("l2", 0)}
        elif self.base == "svrg":
            more = {"rate": rate}
        elif self.base == "nn":
            more = {"units": int(self.get("units", 4)), "rate": rate, "seed": seed}
        elif self.base == "mf":
            more = {"rank": int(self.get("rank", 4)), "rate": rate, "l2": self.get("l2", 0), "seed": seed}
        kinds: dict[str, type[Kernel]] = {**online.LEARNERS, "OjaNewton": composed.OjaNewton, "ksvm": composed.KernelMachine}
        kind, takes = kinds[self.base], kinds[self.base].__dataclass_fields__

        def make(bits: int, loss: str = "squared", **bounds) -> Kernel:
            own = {"bits": bits, "loss": asked or loss, **more, **{k: v for k, v in bounds.items() if k not in more}}
            return kind(**{k: v for k, v in own.items() if k in takes})

        return make

    def bits(self) -> int:
        bits = int(self.get("b", 12 if self.base == "OjaNewton" else 18))
        if self.base == "OjaNewton" and bits > 14:
            raise ValueError("OjaNewton keeps dense directions: -b 14 at most")
        return bits

    def kernel(self) -> Callable[[], Kernel]:
        """What learns single examples."""
        if self.base == "bfgs":
            raise ValueError("bfgs learns from all examples at once: use fit")
        bits, make = self.bits(), self.maker()
        if not self.layers:
            loss = self.word("loss_function", "squared")
            return lambda: make(bits, loss)
        name, value = self.layers[0]
        if name in EVENTS:
            raise ValueError(f"{name} learns from events, not single examples: use fit_events")
        k = int(value) if value and value.isdigit() else 2
        seed, mellowness = int(self.get("random_seed", 0)), self.get("mellowness", 8.0) if name in ("active", "active_cover") else 8.0
        made: dict[str, Callable[[], Kernel]] = {
            "oaa": lambda: composed.OneAgainstAll(classes=k, bits=bits, make=make), "ect": lambda: composed.Tournament(classes=k, bits=bits, make=make), "log_multi": lambda: composed.LogTree(classes=k, bits=bits, make=make), "plt": lambda: composed.LabelTree(labels=k, bits=bits, make=make),
            "csoaa": lambda: events.CostSensitive(classes=k, bits=bits, make=make), "multilabel_oaa": lambda: composed.MultilabelOneAgainstAll(classes=k, bits=bits, make=make), "boosting": lambda: composed.Boosting(learners=k, bits=bits, make=make), "bootstrap": lambda: composed.Bootstrap(replicas=k, seed=seed, bits=bits, make=make),
            "active": lambda: composed.Active(mellowness=mellowness, seed=seed, bits=bits, make=make), "active_cover": lambda: asking.ActiveCover(mellowness=mellowness, seed=seed, bits=bits, make=make), "cs_active": lambda: asking.CostRanges(classes=k, bits=bits, make=make), "confidence": lambda: asking.Confidence(bits=bits, make=make),
            "baseline": lambda: composed.Baseline(bits=bits, make=make), "replay": lambda: composed.Replay(base=make(bits, self.word("loss_function", "squared")), size=max(k, 2), seed=seed), "memory_tree": lambda: composed.MemoryTree(leaf=max(k, 2), bits=bits, make=make),
            "cbzo": lambda: composed.ZerothOrder(rate=self.get("l", 0.1), bits=bits), "cats_tree": lambda: composed.CatsTree(bins=k, low=self.get("min_value", 0), high=self.get("max_value", 1), bandwidth=int(self.get("bandwidth", 1)), bits=bits, make=make), "binary": lambda: composed.Signed(make(bits, "logistic")),
        }
        made[name]()  # a wrong option shows here, not in a task
        return made[name]

    def policy(self) -> Callable[[], composed.Policy | events.ActionCosts | events.OffsetTree]:
        """What learns events of several actions."""
        bits, make, names = self.bits(), self.maker(), [name for name, _ in self.layers]
        if names[0] in ("csoaa_ldf", "wap_ldf"):
            kind = "pairs" if names[0] == "wap_ldf" else {"oaa": "regression", "mc": "classifier"}[self.word("csoaa_type", "oaa")]
            return lambda: events.ActionCosts(kind, bits=bits, make=make)
        if names[0] == "ot":
            k, epsilon = int(self.layers[0][1] or 2), self.get("epsilon", 0.05)
            return lambda: events.OffsetTree(k, epsilon, bits, make)
        own = {"estimator": self.word("cb_type", "mtr"), "clip": self.get("clip_p", 0.0), "seed": int(self.get("random_seed", 0))}
        if own["estimator"] not in ("mtr", "ips", "dm", "dr", "sm"):
            raise ValueError(f"--cb_type {own['estimator']}")
        if "cb_explore_adf" in names or "cb_explore" in names:
            own["epsilon"] = self.get("epsilon", 0.05)
            if self.has("softmax"):
                own |= {"explore": "softmax", "temperature": self.get("lambda", 1.0)}
            elif self.has("squarecb"):
                own |= {"explore": "squarecb", "gamma": self.get("gamma_scale", 10.0)}
            elif self.has("bag"):
                own |= {"explore": "bag", "bags": int(self.get("bag", 5))}
            elif self.has("cover"):
                own |= {"explore": "cover", "bags": int(self.get("cover", 5)), "psi": self.get("psi", 1.0)}
            elif self.has("first"):
                own |= {"explore": "first", "gamma": self.get("first", 0)}
        else:
            own["epsilon"] = 0.0
        return lambda: composed.Policy(bits=bits, make=make, **own)

    # --- training ---------------------------------------------------------------------------------

    def _run(self) -> Run:
        passes = int(self.get("passes", 1))
        after = int(self.get("holdout_after", 0))
        period, patience = int(self.get("holdout_period", 10)), int(self.get("early_terminate", 3))
        off = self.has("holdout_off") or passes < 2
        return Run(self.kernel(), passes, 0 if off or after else period, 0 if off else patience, 0 if off else after, self.has("save_per_pass"))

    def fit(self, examples: DataFrame, group: list[str], seq: str = "seq", label: str = "y", weight: str = "weight", start: DataFrame | None = None) -> Model:
        """Trains on (group, seq, y, weight, features): one model for each group, shards in parallel.

        Multiclass labels count from 1; csoaa, cs_active take arrays of costs for a label,
        multilabel_oaa arrays of classes. ``start`` are weights of an earlier model to go on from."""
        w = F.col(weight)
        if weights := self.all("classweight"):
            from ..operators import reductions

            pairs = dict((int(float(a)), float(b)) for s in weights for a, b in [x.split(":") for x in s.split(",")])
            w = w * reductions.classweight(F.col(label).cast("int"), pairs)
        shown = self.features(examples)
        if self.base == "bfgs":
            return self._fit_batch(shown, seq, label, w)
        run = self._run()
        link = self.word("link", "identity")
        self.check()
        rows = hashed(shown, "features", self.bits())
        rows = rows.select(*group, F.col(seq).alias("seq"), "idx", "val", F.col(label).alias("y"), w.alias("weight"))
        out = train(rows, run, group, start)
        if link != "identity":
            out = out.withColumn("p", losses.link(link, F.col("p")))
        return Model(self, out, group)

    def _fit_batch(self, shown: DataFrame, seq: str, label: str, weight: Column) -> Model:
        bits = self.bits()
        loss, l2, passes, memory = self.word("loss_function", "squared"), self.get("l2", 0), int(self.get("passes", 20)), int(self.get("mem", 15))
        self.check()
        rows = shown.select(F.col(seq).alias("id"), F.col(label).alias("y"), weight.alias("weight"), F.explode("features").alias("f")).select("id", "y", "weight", "f.ns", "f.name", "f.value")
        w, _, _ = batch.lbfgs(rows, loss, passes, memory, l2)
        made = hashed(w.select(F.array(F.struct("ns", "name", F.lit(1.0).alias("value"))).alias("features"), "w"), "features", bits)
        out = made.select(F.lit("weight").alias("kind"), F.lit(None).cast("long").alias("seq"), F.get("idx", F.lit(0)).alias("idx"), F.lit(None).cast("double").alias("p"), "w", F.lit(None).cast("double").alias("state"))
        return Model(self, out, [])

    def fit_events(self, rows: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
        """(group..., seq, slot, best, pmf): what the policy would have done with each event, or slot of
        one, before it learnt from it.

        ``rows`` have (group..., seq, shared array<feature>, actions array<array<feature>>) and
        ``chosen``, ``cost``, ``p`` (bandits; for cb, cb_explore and ot ``actions`` may be absent: the
        layer's number says how many), ``costs`` (csoaa_ldf, wap_ldf) or ``slots``
        array<array<feature>> with ``outcomes`` array<struct<action, cost, p>> (ccb_explore_adf, and
        slates with ``pools`` array<array<int>>)."""
        make, name = self.policy(), self.layers[0][0]
        single = name in ("cb", "cb_explore", "ot")
        spaces = self._spaces(rows, F.col("shared") if single else F.concat(F.col("shared"), F.flatten("actions")))
        one = self.expression
        if single:
            lists = F.array(one(F.col("shared"), spaces))
        else:
            lists = F.transform("actions", lambda a: one(F.concat(a, F.col("shared")), spaces))
        slotted = name in ("slates", "ccb_explore_adf")
        if slotted:
            lists = F.concat(lists, F.col("slots"))
        self.check()
        bits, count = self.bits(), int(self.layers[0][1] or 0) if single else 0
        listed = rows.withColumn("__lists", lists)
        flat = hashed(listed.select("*", F.flatten("__lists").alias("__flat"), F.transform("__lists", F.size).alias("__sizes")), "__flat", bits)
        wanted = ["chosen", "cost", "p"] if not slotted and name not in ("csoaa_ldf", "wap_ldf") else ["costs"] if not slotted else ["outcomes", *(["pools"] if name == "slates" else [])]
        n_slots = F.size("slots") if slotted else F.lit(0)
        src = flat.select(*group, F.col(seq).alias("seq"), "idx", "val", F.col("__sizes").alias("sizes"), n_slots.alias("n_slots"), *wanted)
        keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)

        def fold(key: tuple, table: pa.Table) -> pa.Table:
            learner, out = make(), []
            table = table.sort_by("seq")
            idx, val = online._Lists(table["idx"], np.int64), online._Lists(table["val"], np.float64)
            rest = table.select(["seq", "sizes", "n_slots", *wanted]).to_pylist()
            for j, x in enumerate(rest):
                cuts = np.cumsum(x["sizes"])[:-1]
                parts = list(zip(np.split(idx[j], cuts), np.split(val[j], cuts), strict=True))
                out += [(x["seq"], slot, int(best), [float(p) for p in pmf]) for slot, best, pmf in _learn_event(name, learner, parts, x, count, bits)]
            n = len(out)
            cols = {k: pa.array([v.as_py() if hasattr(v, "as_py") else v] * n, table.schema.field(k).type) for k, v in zip(group, key, strict=True)}
            return pa.table(cols | {"seq": pa.array([o[0] for o in out], pa.int64()), "slot": pa.array([o[1] for o in out], pa.int32()), "best": pa.array([o[2] for o in out], pa.int32()), "pmf": pa.array([o[3] for o in out], pa.list_(pa.float64()))})

        return src.groupBy(*group).applyInArrow(fold, f"{keys}, seq long, slot int, best int, pmf array<double>")


def _learn_event(name, learner, parts, x, count, bits):
    """(slot, best action, distribution) of an event before it is learnt."""
    if name in ("csoaa_ldf", "wap_ldf"):
        pmf = learner.probabilities(parts)
        return [(0, learner.learn(parts, x["costs"])[0], pmf)]
    if name == "ot":
        pmf = learner.learn(*parts[0], x["chosen"], x["cost"], x["p"])
        return [(0, np.argmax(pmf), pmf)]
    if name in ("cb", "cb_explore"):
        # A class's weights stand apart from another's by an offset of the index.
        parts = [((parts[0][0] + k * 0x9E3779B1) & ((1 << bits) - 1), parts[0][1]) for k in range(count)]
    if x["n_slots"]:
        actions, slots = parts[: -x["n_slots"]], parts[-x["n_slots"] :]
        return events.learn_slots(learner, actions, slots, x["outcomes"], x.get("pools"))
    pmf = learner.learn(parts, x["chosen"], x["cost"], x["p"])
    return [(0, np.argmax(pmf), pmf)]


def fit_many(stacks: dict[str, Stack], examples: DataFrame, group: list[str]) -> DataFrame:
    """(model, group..., seq, p): several stacks trained on the same examples, by name."""
    out = None
    for name, stack in stacks.items():
        one = stack.fit(examples, group).predictions.select(F.lit(name).alias("model"), *group, "seq", "p")
        out = one if out is None else out.unionByName(one)
    return out


def _by_space(values: list[str], spaces: list[str]) -> list[tuple[str, int]]:
    """``a2`` is 2 for namespaces that begin with a; a bare number is for all."""
    out: dict[str, int] = {}
    for value in values:
        if value.isdigit():
            out |= dict.fromkeys(spaces, int(value))
        else:
            out[value[0]] = int(value[1:])
    return list(out.items())


@dataclass
class Model:
    """A trained stack: predictions made while learning, weights by group."""

    stack: Stack
    output: DataFrame
    group: list[str]

    @property
    def predictions(self) -> DataFrame:
        return self.output.where("kind = 'prediction'").select(*self.group, "seq", "p")

    @property
    def weights(self) -> DataFrame:
        return self.output.where("kind = 'weight'").select(*self.group, "idx", "w", "state")

    def transform(self, examples: DataFrame, key: str) -> DataFrame:
        """Scores of unseen examples with the shards' mean: one join by index."""
        rows = hashed(self.stack.features(examples), "features", self.stack.bits())
        n = (self.weights.select(*self.group).distinct().count() if self.group else 1) or 1
        mean = self.weights.groupBy("idx").agg((F.sum("w") / n).alias("w")).withColumn("kind", F.lit("weight"))
        return online.scored(rows, mean, key)

    def merge(self, other: Model) -> DataFrame:
        """The mean of two models' weights by their adaptive state."""
        tagged = [m.weights.select(F.lit(k).alias("model"), F.lit("").alias("ns"), F.col("idx").cast("string").alias("name"), "w", F.col("state").alias("adapt"), F.lit(1).alias("examples")) for k, m in enumerate((self, other))]
        return batch.merge(tagged[0].unionByName(tagged[1]).where("adapt > 0"), state="adapt").select(F.col("name").cast("long").alias("idx"), "w", F.col("adapt").alias("state"))
