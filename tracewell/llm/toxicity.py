"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a vector of the word, by hash, and what a smaller bidirectional gated network makes of its characters in
order. The main network reads windows of words that overlap by half; attention pools the hidden states of both directions; a
text's score is that of its worst window. Only the label of a whole text is known, so training takes windows of each text at
random at first, and later those that score worst. All vectors of words start at zero: what isn't learned says nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tracewell.llm._shared import bound_batches, release, unit_hash

WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH = 12, 12  # units a direction; dimensions of a word's vector
CHAR_UNITS, CHAR_WIDTH, CHARS = 8, 8, 512  # units a direction and dimensions of the character network; buckets of characters
BUCKETS = 1 << 16
MOST_FALSE = 0.02  # of the clean texts kept from training, the share that may score 0.5 or more
LEAST_STEPS = 200  # of training, however few texts there are
LOOKED_AT = 16  # windows of a text among which an epoch of training looks for the worst
RATE = 0.03  # of learning word vectors
MOST_CHARS = 40_000  # longer texts aren't trained on
_WORD = re.compile(r"\w+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Words:
    """Bucket of each word, and its characters: buckets in one array, with each word's first place and length."""

    bucket: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        parts = [cls._of(words[a : a + 20_000]) for a in range(0, len(words), 20_000)]  # few intermediate values at a time
        base = np.cumsum([0, *(len(p.chars) for p in parts)])
        return cls(np.concatenate([p.bucket for p in parts]), np.concatenate([p.chars for p in parts]), np.concatenate([p.first + b for p, b in zip(parts, base, strict=False)]), np.concatenate([p.size for p in parts]))

    @classmethod
    def _of(cls, words: list[str]) -> Words:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size
        place = np.arange(len(codes)) - np.repeat(first, size)
        h = _mix((codes + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint64)
        whole = np.add.reduceat((h + np.uint64(1)) * (h + np.uint64(12345)), first)
        return cls(_mix(whole), (codes % np.uint64(CHARS)).astype(np.int32), first, size)

    def some(self, which: np.ndarray) -> Words:
        return Words(self.bucket[which], self.chars, self.first[which], self.size[which])


def window_starts(n: int) -> list[int]:
    """Starts of the windows over ``n`` words: each overlaps the one before, and the last ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Word numbers of all windows of a text; 0 fills a short text's only window."""
    if len(ids) < WINDOW:
        ids = np.concatenate([ids, np.zeros(WINDOW - len(ids), ids.dtype)])
    return ids[np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Pass:
    """One direction of a gated network: ``steps`` row numbers into ``gates`` for each sequence; sequences that have ended stay.

    ``live[t]`` sequences, the first ones, take part in step t.
    """

    def __init__(self, gates: np.ndarray, at: np.ndarray, live: np.ndarray, u: np.ndarray, keep: bool):
        self.at, self.live, self.u, self.saved = at, live, u, []
        n, h3 = at.shape[0], u.shape[0]
        self.states = np.empty((at.shape[1], n, h3), gates.dtype)
        h = np.zeros((n, h3), gates.dtype)
        for t, m in enumerate(live):
            x, old = gates[at[:m, t]], h[:m]
            hu = old @ u
            zr = _sigmoid(x[:, : 2 * h3] + hu[:, : 2 * h3])
            z, r = zr[:, :h3], zr[:, h3:]
            new = np.tanh(x[:, 2 * h3 :] + r * hu[:, 2 * h3 :])
            if keep:
                self.saved.append((old, z, r, new, hu[:, 2 * h3 :]))
            h = np.concatenate([new + z * (old - new), h[m:]]) if m < n else new + z * (old - new)
            self.states[t] = h

    def back(self, d_states: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``u`` and of the ``rows`` gate inputs, from those of the states."""
        u, h3 = self.u, self.u.shape[0]
        du, dh, parts = np.zeros_like(u), np.zeros_like(self.states[0]), []
        for t in range(len(self.live) - 1, -1, -1):
            h, z, r, new, hun = self.saved[t]
            m = self.live[t]
            dh = dh + d_states[t]
            d = dh[:m]
            d_new = d * (1 - z) * (1 - new * new)
            dz, dr = d * (h - new) * z * (1 - z), d_new * hun * r * (1 - r)
            d_hu = np.concatenate([dz, dr, d_new * r], axis=1)
            du += h.T @ d_hu
            parts.append((self.at[:m, t], np.concatenate([dz, dr, d_new], axis=1)))
            dh = np.concatenate([d * z + d_hu @ u.T, dh[m:]])
        return du, _summed(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), rows)


@dataclass
class GatedNetwork:
    """Parameters: vectors of words and characters, and for each direction of both networks input, recurrent and bias weights."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0  # added to a text's logit, so that 0.5 is the best threshold

    @classmethod
    def fresh(cls, seed: int) -> GatedNetwork:
        r, d = np.random.default_rng(seed), WIDTH + 2 * CHAR_UNITS
        p = {"words": np.zeros((BUCKETS, WIDTH)), "chars": r.normal(0, 0.5, (CHARS, CHAR_WIDTH))}
        for net, units, width in (("", HIDDEN, d), ("char_", CHAR_UNITS, CHAR_WIDTH)):
            for side in "fb":
                p |= {f"{net}w{side}": r.normal(0, width**-0.5, (width, 3 * units)), f"{net}u{side}": r.normal(0, units**-0.5, (units, 3 * units)), f"{net}c{side}": np.zeros(3 * units)}
        p |= {"attend": r.normal(0, 0.3, 2 * HIDDEN), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.array([-1.0])}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def spell(self, words: Words, keep: bool = False) -> tuple[np.ndarray, list]:
        """The last states of both directions over each word's characters."""
        order = np.argsort(-words.size, kind="stable")
        size, first = words.size[order], words.first[order]
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), "left")
        t = np.arange(steps)[None, :]
        out, passes = np.empty((len(size), 2 * CHAR_UNITS), self.p["chars"].dtype), []
        for k, side in enumerate("fb"):
            place = first[:, None] + (t if side == "f" else size[:, None] - 1 - t)
            at = words.chars[np.clip(place, 0, len(words.chars) - 1)]
            one = Pass(self.p["chars"] @ self.p[f"char_w{side}"] + self.p[f"char_c{side}"], at, live, self.p[f"char_u{side}"], keep)
            out[order, k * CHAR_UNITS : (k + 1) * CHAR_UNITS] = one.states[-1]
            passes.append(one)
        return out, [order, passes]

    def vectors(self, words: Words, block: int = 4096) -> np.ndarray:
        """Word vectors, block after block of words of like length."""
        out = np.empty((len(words.size), WIDTH + 2 * CHAR_UNITS), np.float32)
        order = np.argsort(words.size, kind="stable")
        for a in range(0, len(order), block):
            some = order[a : a + block]
            out[some, WIDTH:] = self.spell(words.some(some))[0]
        out[:, :WIDTH] = self.p["words"][words.bucket]
        return out

    def inputs(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Gate inputs of each word vector, for both directions."""
        return {s: x @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"}

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of the windows ``at`` (word numbers into ``gates``; 0 is padding)."""
        live = np.full(at.shape[1], len(at))
        f, b = Pass(gates["f"], at, live, self.p["uf"], keep), Pass(gates["b"], at[:, ::-1], live, self.p["ub"], keep)
        states = np.concatenate([f.states, b.states[::-1]], axis=2)
        e = states @ self.p["attend"] + np.where(at.T == 0, np.float32(-1e4), np.float32(0))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        context = np.einsum("tnh,tn->nh", states, a)
        return context @ self.p["out"] + self.p["bias"][0], {"f": f, "b": b, "states": states, "a": a, "context": context} if keep else {}

    def gradients(self, x: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted cross-entropy, and of the word vectors ``x``."""
        p, gates = self.p, self.inputs(x)
        logit, s = self.forward(gates, at, keep=True)
        d_logit = (_sigmoid(logit) - target) * weight / weight.sum()
        g = {"out": s["context"].T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_context = d_logit[:, None] * p["out"]
        states, a = s["states"], s["a"]
        d_a = (states * d_context).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[:, :, None] * d_context + d_e[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for side, d in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[::-1, :, HIDDEN:])):
            du, d_gate = s[side].back(d, len(x))
            g |= {f"u{side}": du, f"w{side}": x.T @ d_gate, f"c{side}": d_gate.sum(0)}
            dx += d_gate @ p[f"w{side}"].T
        return g, dx

    def spelling_gradients(self, made: list, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the character network, from those of the states that ``spell`` gave."""
        (order, passes), g = made, {"chars": np.zeros_like(self.p["chars"])}
        for k, side in enumerate("fb"):
            d_states = np.zeros_like(passes[k].states)
            d_states[-1] = d[order, k * CHAR_UNITS : (k + 1) * CHAR_UNITS]
            du, d_gate = passes[k].back(d_states, CHARS)
            g |= {f"char_u{side}": du, f"char_w{side}": self.p["chars"].T @ d_gate, f"char_c{side}": d_gate.sum(0)}
            g["chars"] += d_gate @ self.p[f"char_w{side}"].T
        return g


class WordTable:
    """Numbers the words met, from 1; 0 is padding."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        for w in dict.fromkeys(words):
            if w not in number:
                number[w] = len(number) + 1
        return np.fromiter(map(number.__getitem__, words), np.int32, len(words))

    def features(self, first: int = 0) -> Words | None:
        new = list(self.number)[first:]
        return Words.of(new) if new else None


def train(texts: list[str], labels: list[int], epochs: int = 8, seed: int = 1) -> GatedNetwork:
    """Fit the network on labelled texts; a fifth of them sets the threshold. Without both labels it is left untrained."""
    y = np.array(labels, np.float32)
    net = GatedNetwork.fresh(seed)
    if len(set(labels)) < 2:
        net.shift = -10.0
        return net
    table, r = WordTable(), np.random.default_rng(seed)
    wins = [windows_of(table.ids(_WORD.findall(t.lower()))) for t in texts]
    words = table.features()
    if words is None:
        net.shift = -10.0
        return net
    test = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~test) if len(set(y[~test].tolist())) == 2 else np.arange(len(y))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def scores(some: list[np.ndarray]) -> list[np.ndarray]:
        flat = np.concatenate(some)
        met, local = np.unique(flat, return_inverse=True)
        local = local.reshape(flat.shape) + (met[0] != 0)
        gates = net.inputs(np.vstack([np.zeros((1, WIDTH + 2 * CHAR_UNITS), np.float32), net.vectors(words.some(met[met > 0] - 1))]))
        out = np.concatenate([net.forward(gates, local[a : a + 1024])[0] for a in range(0, len(flat), 1024)])
        return np.split(out, np.cumsum([len(w) for w in some])[:-1])

    epochs = max(epochs, -(-LEAST_STEPS * 128 // (2 * len(fit))))
    for epoch in range(epochs):
        some = [wins[k] if len(wins[k]) <= LOOKED_AT else wins[k][r.choice(len(wins[k]), LOOKED_AT, replace=False)] for k in fit]
        blind = epoch < max(1, epochs // 4)
        logits = [r.random(len(w)) for w in some] if blind else scores(some)
        chosen, target = [], []
        for k, w, s in zip(fit, some, logits, strict=True):
            picks = set(np.argsort(-s)[:2].tolist()) if blind else {int(s.argmax())} if y[k] else {int(s.argmax()), int(r.integers(len(s)))}
            chosen += [w[j] for j in picks]
            target += [y[k]] * len(picks)
        at, target = np.stack(chosen), np.array(target, np.float32)
        weight = np.where(target == 1, (target == 0).sum() / max(1, target.sum()), 1).astype(np.float32) ** 0.5
        order = r.permutation(len(at))
        for a in range(0, len(order), 128):
            batch = order[a : a + 128]
            met, local = np.unique(at[batch], return_inverse=True)
            local = local.reshape(at[batch].shape) + (met[0] != 0)
            own = words.some(met[met > 0] - 1)
            spelt, made = net.spell(own, keep=True)
            x = np.vstack([np.zeros((1, WIDTH + 2 * CHAR_UNITS), np.float32), np.hstack([net.p["words"][own.bucket], spelt])])
            g, dx = net.gradients(x, local, target[batch], weight[batch])
            g |= net.spelling_gradients(made, dx[1:, WIDTH:])
            step += 1
            rate = 0.01 * min(1, step / 20) * (0.3 if epoch >= epochs - 2 else 1)
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for key, grad in g.items():
                m, v = state[key]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.p[key] -= (rate * fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            rows, inverse = np.unique(own.bucket, return_inverse=True)
            grad = _summed(inverse, dx[1:, :WIDTH], len(rows))
            v = state["words"][1]
            v[rows] += grad * grad  # sparse rows: adaptive steps without momentum
            net.p["words"][rows] -= RATE * grad / (np.sqrt(v[rows]) + 1e-4)
    held = np.flatnonzero(test) if test.any() and len(set(y[test].tolist())) == 2 else fit
    top = np.array([s.max() for s in scores([wins[k] for k in held])])
    clean = np.sort(top[y[held] == 0])
    net.shift = -max(best_threshold(top, y[held]), float(clean[int((1 - MOST_FALSE) * (len(clean) - 1))]) + 0.01)
    return net


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the greatest F1."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    ends = [(s[k] - (s[k + 1] if k + 1 < len(s) else s[k] - 2), (s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 2)) / 2) for k in np.flatnonzero(f1 >= f1.max() - 1e-9)]
    return float(max(ends)[1])


class Scorer:
    """Scores whole texts; the words met are kept up to ``limit`` and then gathered anew."""

    def __init__(self, net: GatedNetwork, limit: int = 120_000):
        self.net, self.limit = net, limit
        self.reset()

    def reset(self) -> None:
        self.table = WordTable()
        self.gates = {s: self.net.p[f"c{s}"][None, :].copy() for s in "fb"}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.table.number) > self.limit:
            self.reset()
        known = len(self.table.number)
        wins = [windows_of(self.table.ids(_WORD.findall((t or "").lower()))) for t in texts]
        if (new_words := self.table.features(known)) is not None:
            new = self.net.inputs(self.net.vectors(new_words))
            self.gates = {s: np.concatenate([self.gates[s], new[s]]) for s in "fb"}
        flat = np.concatenate(wins)
        logit = np.concatenate([self.net.forward(self.gates, flat[a : a + 1024])[0] for a in range(0, len(flat), 1024)])
        first = np.cumsum([0, *(len(w) for w in wins[:-1])])
        worded = np.array([w[0, 0] > 0 for w in wins])  # a window of padding alone has no words
        return np.where(worded, _sigmoid(np.maximum.reduceat(logit, first).astype(np.float64) + self.net.shift), 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_of_each: int) -> DataFrame:
    """At most ``most_of_each`` texts of each label and of ``MOST_CHARS`` characters or fewer, those first by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")  # other documents' labels aren't looked at
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    share = F.when(F.col("toxic") == 1, F.lit(3.0 * most_of_each / counts.get(1, 1))).otherwise(F.lit(3.0 * most_of_each / counts.get(0, 1)))
    some = known.where(unit_hash("doc_id") < share)  # enough, though some are too long or not in docs
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= MOST_CHARS)
    found = texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").distinct()
    of = [found.where(F.col("toxic") == toxic).orderBy(unit_hash("doc_id"), "doc_id", "text").limit(most_of_each) for toxic in (0, 1)]
    return of[0].unionByName(of[1])


def fitted(sample: DataFrame, epochs: int) -> GatedNetwork:
    """The network trained on ``sample`` (doc_id, text, toxic), whose size is bounded, in one task; the driver gets its weights."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0]), 3), r[1], r[2]))
        net = train([t for _, t, _ in rows], [y for *_, y in rows], epochs)
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(net)], pa.binary())})

    made = sample.coalesce(1).mapInArrow(fit, "net binary").first()
    return pickle.loads(made.net) if made else train([], [])


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, sample_of_each: int = 2000, epochs: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns ``carry`` for every whole text of ``docs``, by a network trained on labelled texts of ``training``.

    At most ``sample_of_each`` texts of each label are used, of ``MOST_CHARS`` characters or fewer, so what the task
    that trains holds is bounded. Null and empty texts, and texts without
    words, score 0. Repeated rows and null ids are kept; an empty table gives no rows; with
    labels of one kind or none every score is near 0. Extra columns are ignored unless carried.
    """
    if {"doc_id", "score"} & set(carry):
        raise ValueError("doc_id and score are made here and can't be carried along")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(labelled_sample(training, labels, sample_of_each), epochs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, a = [], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b] or "") < 400_000):
                    size += len(texts[b] or "")
                    b += 1
                out.append(scorer.score(texts[a:b]))
                a = b
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *carry])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    kept = [StructField(c, docs.schema[c].dataType) for c in carry]
    return rows.mapInArrow(run, StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *kept]))
