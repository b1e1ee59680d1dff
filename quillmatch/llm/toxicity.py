"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in NumPy.

A token is a run of letters, digits or non-ASCII bytes, ASCII in lower case. Its input is a hashed word vector beside the
scaled sum of its hashed character n-gram vectors. Every text is cut into windows of WINDOW tokens, one each STRIDE tokens, to
its end. The network reads a window both ways, attention pools its states, and the logits of all windows of a text are
pooled by their own softmax. The driver trains on a bounded sample of labelled rows: SAMPLE per class at most, by least
hash of doc_id, of texts of at most SAMPLE_BYTES bytes; the model has a fixed size. All rows are scored alike.

Defined results: null or tokenless texts are one empty window; without labelled rows of both classes every score is 0;
duplicate labels of a doc_id count as their maximum; of several texts of a labelled doc_id the least is learnt from; a null
doc_id is not held out and never learnt from; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import BASE, flat, mix64, pieces, word_hashes
from .common import table

WINDOW, STRIDE = 24, 16
WORD_BUCKETS, GRAM_BUCKETS = 8192, 16384
GRAMS = (3, 4, 5)
WIDTH, STATES, ATTEND = 8, 12, 8
SAMPLE, SAMPLE_BYTES = 1200, 8000
EPOCHS, BATCH, RATE = 12, 48, 0.01
SHARP = 2.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.array([not (chr(i).isalnum() and i < 128 or i >= 128) for i in range(256)])


class Tokens:
    """Distinct tokens of some texts, the token of each place, and where each text starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        inside = ~_APART[data]
        start, end = inside.copy(), inside.copy()
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        start[1:] &= ~inside[:-1]
        start[edge] = inside[edge]
        end[:-1] &= ~inside[1:]
        end[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(starts, offsets)
        hashes = word_hashes(data, starts, ends)
        distinct, where, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64)
        # the character n-grams of each distinct token, with a mark before and after it
        begin, size = starts[where], (ends - starts)[where]
        marked = size + 2
        at = np.concatenate([[0], np.cumsum(marked)])
        place = np.arange(at[-1]) - np.repeat(at[:-1], marked)
        left = np.repeat(marked, marked) - place
        codes = data[np.minimum(np.repeat(begin, marked) + np.maximum(place - 1, 0), max(0, len(data) - 1))].astype(np.uint64)
        codes[place == 0], codes[left == 1] = 1, 2
        codes = np.concatenate([codes, np.zeros(max(GRAMS), np.uint64)])
        ids, fits = np.zeros((at[-1], len(GRAMS)), np.int64), np.zeros((at[-1], len(GRAMS)), bool)
        with np.errstate(over="ignore"):
            for k, n in enumerate(GRAMS):
                value = np.full(at[-1], n, np.uint64)
                for j in range(n):
                    value = value * BASE + codes[j : j + at[-1]]
                ids[:, k], fits[:, k] = mix64(value) % np.uint64(GRAM_BUCKETS), left >= n
        self.grams = ids[fits]
        self.begin = np.concatenate([[0], np.cumsum(sum(np.maximum(marked - n + 1, 0) for n in GRAMS))])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first token of each window, the text's end, and the index of each text's first window (one more at the end)."""
        n = np.diff(self.first)
        count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
        at = np.concatenate([[0], np.cumsum(count)])
        k = np.arange(at[-1]) - np.repeat(at[:-1], count)
        return np.repeat(self.first[:-1], count) + k * STRIDE, np.repeat(self.first[1:], count), at


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "words": r(WORD_BUCKETS, WIDTH, scale=0.3), "grams": r(GRAM_BUCKETS, WIDTH, scale=0.2),
        "input": r(2 * WIDTH, 6 * STATES, scale=0.25), "bias": np.zeros(6 * STATES, np.float32),
        "ahead": r(STATES, 3 * STATES, scale=0.2), "back": r(STATES, 3 * STATES, scale=0.2),
        "attend": r(2 * STATES, ATTEND, scale=0.3), "attend_bias": np.zeros(ATTEND, np.float32), "query": r(ATTEND, scale=0.3),
        "out": r(2 * STATES, scale=0.3), "out_bias": np.full(1, -1.0, np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def inputs(model: dict, t: Tokens) -> np.ndarray:
    """(distinct tokens, 2 * WIDTH)"""
    size = np.diff(t.begin)
    grams = np.add.reduceat(model["grams"][t.grams], t.begin[:-1], axis=0) if len(size) else np.zeros((0, WIDTH), np.float32)
    return np.concatenate([model["words"][t.words], grams / np.sqrt(size)[:, None].astype(np.float32)], 1)


def read(model: dict, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """gates (WINDOW, windows, 6 * STATES), mask (WINDOW, windows) to states (WINDOW, windows, 2 * STATES)."""
    steps, n, _ = gates.shape
    states = np.zeros((steps, n, 2 * STATES), np.float32)
    s = STATES
    for half, weight in ((0, model["ahead"]), (1, model["back"])):
        h = np.zeros((n, s), np.float32)
        for t in range(steps) if half == 0 else range(steps - 1, -1, -1):
            g = gates[t, :, half * 3 * s : (half + 1) * 3 * s]
            u = h @ weight
            zr = sigmoid(g[:, : 2 * s] + u[:, : 2 * s])
            z = zr[:, :s] * mask[t][:, None]
            c = np.tanh(g[:, 2 * s :] + zr[:, s:] * u[:, 2 * s :])
            if keep is not None:
                keep.append((half, t, h, zr[:, :s], z, zr[:, s:], u[:, 2 * s :], c))
            h = h + z * (c - h)
            states[t, :, half * s : (half + 1) * s] = h
    return states


def attend(model: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    u = np.tanh(states @ model["attend"] + model["attend_bias"])
    a = u @ model["query"] + (mask - 1) * np.float32(1e4)
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    return u, a, pooled, pooled @ model["out"] + model["out_bias"]


def pool(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's logit, and every window's weight in it."""
    size = np.diff(at)
    e = np.exp(SHARP * (logits - np.repeat(np.maximum.reduceat(logits, at[:-1]), size)))
    weight = e / np.repeat(np.add.reduceat(e, at[:-1]), size)
    return np.add.reduceat(weight * logits, at[:-1]), weight


def _gather(t: Tokens, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = begin[None, :] + np.arange(WINDOW)[:, None]
    mask = place < end[None, :]
    last = max(0, len(t.which) - 1)
    which = t.which[np.minimum(place, last)] if len(t.which) else np.zeros(place.shape, np.int64)
    return which, mask.astype(np.float32)


def scores(model: dict, data: np.ndarray, offsets: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The score of each text, over all its windows."""
    t = Tokens(data, offsets)
    table_ = inputs(model, t) @ model["input"] + model["bias"]
    if not len(table_):
        table_ = np.zeros((1, 6 * STATES), np.float32)
    begin, end, at = t.windows()
    logits = np.empty(len(begin), np.float32)
    for k in range(0, len(begin), chunk):
        which, mask = _gather(t, begin[k : k + chunk], end[k : k + chunk])
        logits[k : k + chunk] = attend(model, read(model, table_[which], mask), mask)[3]
    return sigmoid(pool(logits, at)[0].astype(np.float64))


def gradients(model: dict, t: Tokens, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of some texts with their labels and weights."""
    x = inputs(model, t)
    begin, end, at = t.windows()
    which, mask = _gather(t, begin, end)
    flat_which = which.reshape(-1)
    kept: list = []
    gates = (x @ model["input"] + model["bias"])[which]
    states = read(model, gates, mask, kept)
    u, a, pooled, logits = attend(model, states, mask)
    text, share = pool(logits, at)
    p = sigmoid(text)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, text) - label * text)).sum() / total)
    d_text = np.repeat(weight * (p - label) / total, np.diff(at))
    d_logit = (d_text * share * (1 + SHARP * (logits - np.repeat(text, np.diff(at))))).astype(np.float32)
    g: dict[str, np.ndarray] = {"out": d_logit @ pooled, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * model["out"]
    d_states = a[:, :, None] * d_pooled
    d_a = (states * d_pooled).sum(2)
    d_s = a * (d_a - (a * d_a).sum(0))
    d_u = d_s[:, :, None] * model["query"] * (1 - u * u)
    g["query"] = np.einsum("tb,tba->a", d_s, u)
    g["attend"] = np.tensordot(states, d_u, ([0, 1], [0, 1]))
    g["attend_bias"] = d_u.sum((0, 1))
    d_states += d_u @ model["attend"].T
    s = STATES
    d_gates = np.zeros_like(gates)
    g["ahead"], g["back"] = np.zeros_like(model["ahead"]), np.zeros_like(model["back"])
    d_h, before = None, None
    for half, step, h, z_raw, z, r, uc, c in reversed(kept):
        if half != before:
            d_h, before = np.zeros_like(h), half
        d_h = d_h + d_states[step, :, half * s : (half + 1) * s]
        m = mask[step][:, None]
        d_c = d_h * z * (1 - c * c)
        d_z = d_h * (c - h) * m * z_raw * (1 - z_raw)
        d_r = d_c * uc * r * (1 - r)
        d_g = np.concatenate([d_z, d_r, d_c], 1)
        d_u_h = np.concatenate([d_z, d_r, d_c * r], 1)
        name = "ahead" if half == 0 else "back"
        g[name] += h.T @ d_u_h
        d_h = d_h * (1 - z) + d_u_h @ model[name].T
        d_gates[step, :, half * 3 * s : (half + 1) * 3 * s] = d_g
    d_flat = d_gates.reshape(-1, 6 * s) * mask.reshape(-1, 1)
    order = np.argsort(flat_which, kind="stable")
    used, first = np.unique(flat_which[order], return_index=True)
    d_table = np.zeros((len(x), 6 * s), np.float32)
    if len(x):
        d_table[used] = np.add.reduceat(d_flat[order], first, axis=0)
    g["input"], g["bias"] = x.T @ d_table, d_table.sum(0)
    d_x = d_table @ model["input"].T
    size = np.diff(t.begin)
    g["words"], g["grams"] = np.zeros_like(model["words"]), np.zeros_like(model["grams"])
    np.add.at(g["words"], t.words, d_x[:, :WIDTH])
    np.add.at(g["grams"], t.grams, np.repeat(d_x[:, WIDTH:] / np.sqrt(size)[:, None].astype(np.float32), size, 0))
    return loss, g


def _tokens(texts: list[str]) -> Tokens:
    return Tokens(*flat(pa.array(texts, pa.string())))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray] | None:
    """The model, or None where one class has no text."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    model = new_model(seed)
    heavy = np.where(y > 0, np.sqrt((y == 0).sum() / (y > 0).sum()), 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    steps = max(1, -(-len(y) // BATCH))
    rounds = max(epochs, -(-150 // steps))  # a small sample is gone through more often
    n = 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            some = order[k : k + BATCH]
            _, g = gradients(model, _tokens([texts[i] for i in some]), y[some], heavy[some])
            n += 1
            rate = RATE * (1 - 0.9 * n / (rounds * steps))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for name, v in g.items():
                v = v * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                first[name] += 0.1 * (v - first[name])
                second[name] += 0.01 * (v * v - second[name])
                model[name] -= (rate * (first[name] / (1 - 0.9**n)) / (np.sqrt(second[name] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
    return model


def remainder(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list:
    """(text, toxic) of at most per_class labelled rows of either class; those held out are never among them."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = F.broadcast(least(0).unionByName(least(1)))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.octet_length("text") <= most_bytes)
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return sorted(((r.doc_id, r.text, r.toxic) for r in rows.collect()), key=lambda x: x[0])


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for whole in batches:
            for batch in pieces(whole, "text", 1_000_000):
                made = np.zeros(batch.num_rows) if net is None else scores(net, *flat(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = sample(docs, table(spark, sf_dir, "labels"))
    model = train([x[1] for x in rows], [x[2] for x in rows])
    out = scored(docs, model)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
