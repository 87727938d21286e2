"""Language identification by a bidirectional gated recurrent network over bytes.

Two small gated recurrences read every byte of a text, one from each side, and every position
gets language probabilities from both states; a document's are the mean over its positions. The
network is trained here in numpy by backpropagation through time, on windows drawn from a
bounded sample of labelled rows. Gates are hard sigmoids and candidates soft signs: they cost
a fraction of the usual curves and their derivatives are exact. A text of any length is read
whole, as windows of ``STEPS`` bytes (the last one moved back to end with the text, positions
read twice counted once), many windows side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

STEPS, HIDDEN = 64, 6
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """``inputs`` (2, 256, 3H): what a byte adds to update gate, reset gate and candidate, for each
    direction; ``states`` (2, 3H, H): the same of the state before; ``out`` (2, L, H), ``bias`` (L,)."""

    langs: list[str]
    inputs: np.ndarray
    states: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _forward(net: Network, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Scores (T, L, B) of every position of the windows ``x`` (T, B)."""
    steps, n = x.shape
    hidden = net.states.shape[2]
    h = np.zeros((2, hidden, n), np.float32)
    scores = np.empty((steps, len(net.bias), n), np.float32)
    scores[:] = net.bias[:, None]
    a = np.empty((2, 3 * hidden, n), np.float32)
    g = np.empty_like(a)
    for t in range(steps):
        a[0], a[1] = net.inputs[0][x[t]].T, net.inputs[1][x[steps - 1 - t]].T
        np.matmul(net.states, h, out=g)
        gates = a[:, : 2 * hidden] + g[:, : 2 * hidden]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        new = gates[:, hidden:] * g[:, 2 * hidden :]
        new += a[:, 2 * hidden :]
        size = np.abs(new)
        size += 1
        new /= size
        if keep is not None:
            keep.append((h.copy(), gates, new, g[:, 2 * hidden :].copy(), size))
        h -= new
        h *= gates[:, :hidden]
        h += new
        y = np.matmul(net.out, h)
        scores[t] += y[0]
        scores[steps - 1 - t] += y[1]
        if keep is not None:
            keep[-1] += (h.copy(),)
    return scores


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = scores - scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(1, keepdims=True)
    return scores


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
    steps, n = x.shape
    hidden = net.states.shape[2]
    keep: list = []
    p = _softmax(_forward(net, x, keep))
    loss = -float(np.log(p[:, y, np.arange(n)] + 1e-9).mean())
    d = p
    d[:, y, np.arange(n)] -= 1
    d /= steps * n
    gi, gs, go = np.zeros_like(net.inputs), np.zeros_like(net.states), np.zeros_like(net.out)
    dh = np.zeros((2, hidden, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before, gates, new, gn, size, h = keep[t]
        dy = np.stack([d[t], d[steps - 1 - t]])
        go += np.matmul(dy, h.transpose(0, 2, 1))
        dh += np.matmul(net.out.transpose(0, 2, 1), dy)
        z, r = gates[:, :hidden], gates[:, hidden:]
        dnew = dh * (1 - z) / (size * size)
        dz, dr = dh * (before - new), dnew * gn
        dgates = np.concatenate([dz, dr], 1) * 0.25 * ((gates > 0) & (gates < 1))
        da = np.concatenate([dgates, dnew], 1)
        dg = np.concatenate([dgates, dnew * r], 1)
        gs += np.matmul(dg, before.transpose(0, 2, 1))
        dh = dh * z + np.matmul(net.states.transpose(0, 2, 1), dg)
        np.add.at(gi[0], x[t], da[0].T)
        np.add.at(gi[1], x[steps - 1 - t], da[1].T)
    return loss, [gi, gs, go, d.sum((0, 2))]


def train_network(windows: np.ndarray, labels: np.ndarray, langs: list[str], rounds: int = 240, batch: int = 256, seed: int = 7, rate: float = 0.02) -> Network:
    """Adam over batches with as many windows of each language; ``windows`` (n, STEPS) bytes."""
    rng = np.random.default_rng(seed)
    net = Network(
        langs,
        (rng.normal(size=(2, 256, 3 * HIDDEN)) * 0.3).astype(np.float32),
        (rng.normal(size=(2, 3 * HIDDEN, HIDDEN)) * 0.3).astype(np.float32),
        (rng.normal(size=(2, len(langs), HIDDEN)) * 0.3).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    params = [net.inputs, net.states, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by = [np.flatnonzero(labels == k) for k in range(len(langs))]
    each = max(1, batch // len(langs))
    for step in range(1, rounds + 1):
        at = np.concatenate([rng.choice(own, each) for own in by])
        _, grads = _gradients(net, np.ascontiguousarray(windows[at].T), labels[at])
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (1 - step / rounds * 0.9) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _windows(raw: np.ndarray, off: np.ndarray, row_from: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, row, positions at its end that count) of the windows of all rows that have bytes."""
    size = np.diff(off)
    many = -(-size // STEPS)
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    last = k == many[row] - 1
    start = off[row] + np.where(last, np.maximum(size[row] - STEPS, 0), k * STEPS)
    return start, row, np.where(last, size[row] - k * STEPS, STEPS)


def predict_rows(net: Network, column) -> np.ndarray:
    """(rows, languages): mean probabilities of each row's positions; zeros for rows without bytes."""
    raw, off = C.text_bytes(column)
    start, row, count = _windows(raw, off)
    padded = np.concatenate([raw, np.full(STEPS, 32, np.uint8)])
    total = np.zeros((len(off) - 1, len(net.langs)))
    at = np.arange(STEPS)
    short = np.diff(off)[row] < STEPS
    for a in range(0, len(start), 4096):
        x = padded[start[a : a + 4096, None] + at]
        # A short text stands at the window's start; what follows it is read as spaces.
        if short[a : a + 4096].any():
            x = np.where(short[a : a + 4096, None] & (at >= count[a : a + 4096, None]), np.uint8(32), x)
        p = _softmax(_forward(net, np.ascontiguousarray(x.T)))
        counts = np.where(short[a : a + 4096], at[:, None] < count[a : a + 4096], at[:, None] >= STEPS - count[a : a + 4096])
        pooled = np.einsum("tlb,tb->bl", p, counts.astype(np.float32))
        for k in range(len(net.langs)):
            total[:, k] += np.bincount(row[a : a + 4096], weights=pooled[:, k], minlength=len(total))
    return total / np.maximum(np.diff(off), 1)[:, None]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 600, windows_per_doc: int = 8) -> Network | None:
    """A network fitted to a bounded sample of labelled rows: about ``docs_per_lang`` documents of
    each language, by a hash of their id, and at most ``windows_per_doc`` windows of STEPS bytes
    spread over each whole text. None where no row has a text and a language."""
    rows = labelled.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL AND t RLIKE '\\\\p{L}'")
    counts = sorted((r["l"], r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect())
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, docs_per_lang / n)]), F.col("l"))
    picked = rows.where(F.pmod(F.xxhash64(F.coalesce("i", F.lit("")), F.lit("sample")), F.lit(1_000_003)) < share * 1_000_003)

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = C.text_bytes(batch.column(1))
        padded = np.concatenate([raw, np.full(STEPS, 32, np.uint8)])
        out, lang, ids = [], [], []
        for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
            for s in np.unique(np.linspace(a, max(a, b - STEPS), windows_per_doc).astype(int)) if b > a else ():
                w = padded[s : s + STEPS].copy()
                w[max(0, b - s) :] = 32
                out.append(w.tobytes()), lang.append(batch.column(2)[i].as_py()), ids.append(batch.column(0)[i].as_py())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["i", "l", "w"])

    drawn = C.map_batches(picked, draw, "i string, l string, w binary", text_col=1).toArrow().sort_by([("l", "ascending"), ("i", "ascending"), ("w", "ascending")])
    langs = [lang for lang, _ in counts]
    have = set(drawn["l"].to_pylist())
    langs = [lang for lang in langs if lang in have]
    if not langs:
        return None
    windows = np.frombuffer(b"".join(drawn["w"].to_pylist()), np.uint8).reshape(-1, STEPS)
    return train_network(windows, np.array([langs.index(x) for x in drawn["l"].to_pylist()]), langs)


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__lang`` and ``__score`` (mean probability of that language, 0 to 1).

    Only the text is looked at. Null, empty or letterless text is ``und`` with score 0, as is
    everything where there is no network; ties go to the language first in sorted order; rows
    that repeat get equal answers; every row and column stays."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(texts: pa.Array) -> list[pa.Array]:
        net = held.value
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if net:
            p = predict_rows(net, texts)
            best = p.argmax(1)
            for i, text in enumerate(texts.to_pylist()):
                if text and _LETTER.search(text):
                    lang[i], score[i] = net.langs[best[i]], min(1.0, p[i, best[i]])
        return [pa.array(lang, pa.string()), pa.array(score)]

    return C.map_docs(docs, text_col, run, "__lang string, __score double")
