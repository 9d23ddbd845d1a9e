"""Language of whole texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import inner_names, make_room
from tablewright.llm.wordhash import string_buffers

HIDDEN = 8  # state of each direction
SPAN = 128  # bytes that run through the network together
WINDOWS = 2048  # windows side by side in one step
UNDETERMINED = "und"


@dataclass
class Model:
    """Languages and weights: one input table, recurrence and bias per direction, and the readout."""

    labels: list[str]
    weights: dict[str, np.ndarray]


def _start(classes: int, seed: int) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    h = HIDDEN
    weights = {}
    for side in ("f", "b"):
        weights["x" + side] = random.normal(0, 0.2, (3 * h, 256))
        weights["u" + side] = random.normal(0, 0.3, (3 * h, h))
        weights["n" + side] = np.zeros((h, 1))
    weights["v"] = random.normal(0, 0.3, (classes, 2 * h))
    weights["c"] = np.zeros((classes, 1))
    return {name: value.astype(np.float32) for name, value in weights.items()}


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= np.float32(0.5)
    np.tanh(a, out=a)
    a += np.float32(1)
    a *= np.float32(0.5)
    return a


def _run(x, u, bias, steps, order, trace: list | None = None) -> np.ndarray:
    """States at every position: ``steps`` is (position, window) bytes, the result (position, H, window)."""
    h = HIDDEN
    state = np.zeros((h, steps.shape[1]), np.float32)
    out = np.empty((len(steps), h, steps.shape[1]), np.float32)
    fed = np.empty((3 * h, steps.shape[1]), np.float32)
    for t in order:
        np.take(x, steps[t], axis=1, out=fed, mode="clip")
        back = u @ state
        gates = _sigmoid(fed[: 2 * h] + back[: 2 * h])
        keep, reset = gates[:h], gates[h:]
        inner = back[2 * h :] + bias
        new = np.tanh(fed[2 * h :] + reset * inner)
        if trace is not None:
            trace.append((t, state, keep, reset, inner, new))
        state = new + keep * (state - new)
        out[t] = state
    return out


def _unroll(grads, side, x, u, steps, trace, pulled):
    """Back through time: ``pulled`` holds the gradient of each position's state."""
    h = HIDDEN
    carry = np.zeros_like(pulled[0])
    fed = np.empty((len(steps), 3 * h, steps.shape[1]), np.float32)
    for t, before, keep, reset, inner, new in reversed(trace):
        d = pulled[t] + carry
        d_new = d * (1 - keep) * (1 - new * new)
        d_keep = d * (before - new) * keep * (1 - keep)
        d_inner = d_new * reset
        d_reset = d_new * inner * reset * (1 - reset)
        gates = np.concatenate([d_keep, d_reset, d_inner])
        carry = d * keep + u.T @ gates
        grads["u" + side] += gates @ before.T
        grads["n" + side] += d_inner.sum(axis=1, keepdims=True)
        fed[t, :h], fed[t, h : 2 * h], fed[t, 2 * h :] = d_keep, d_reset, d_new
    flat = steps.ravel()
    for row in range(3 * h):
        grads["x" + side][row] += np.bincount(flat, fed[:, row].ravel(), 256)


def _gradients(weights, steps, mask, target):
    """Mean cross entropy over the labelled positions, and its gradients."""
    traces = {"f": [], "b": []}
    order = {"f": range(len(steps)), "b": range(len(steps) - 1, -1, -1)}
    states = [
        _run(weights["x" + s], weights["u" + s], weights["n" + s], steps, order[s], traces[s])
        for s in ("f", "b")]
    joined = np.concatenate(states, axis=1)
    scores = weights["v"] @ joined + weights["c"]
    scores -= scores.max(axis=1, keepdims=True)
    shares = np.exp(scores)
    shares /= shares.sum(axis=1, keepdims=True)
    truth = np.eye(len(weights["c"]), dtype=np.float32)[target].T[None]
    loss = -(np.log((shares * truth).sum(axis=1) + 1e-9) * mask).sum() / mask.sum()
    pull = (shares - truth) * mask[:, None, :] / mask.sum()
    grads = {name: np.zeros_like(value) for name, value in weights.items()}
    grads["v"] = np.einsum("tcw,thw->ch", pull, joined, optimize=True)
    grads["c"] = pull.sum(axis=(0, 2))[:, None]
    back = np.swapaxes(weights["v"][None], 1, 2) @ pull
    for s, part in (("f", back[:, :HIDDEN]), ("b", back[:, HIDDEN:])):
        _unroll(grads, s, weights["x" + s], weights["u" + s], steps, traces[s], part)
    return loss, grads


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    steps = np.zeros((SPAN, len(texts)), np.uint8)
    for i, text in enumerate(texts):
        steps[: min(SPAN, len(text)), i] = np.frombuffer(text[:SPAN], np.uint8)
    lengths = np.array([min(SPAN, len(t)) for t in texts])
    return steps, (np.arange(SPAN)[:, None] < lengths).astype(np.float32)


def fit_network(texts: list[bytes], labels: list[str], updates: int = 320, seed: int = 7) -> Model:
    """Adam over shuffled batches; every fifth window is shortened, as short texts are."""
    names = sorted(set(labels))
    target = np.array([names.index(label) for label in labels])
    random = np.random.default_rng(seed)
    weights = _start(len(names), seed)
    steps, mask = _windows(texts)
    moment = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}
    queue = np.zeros(0, np.int64)
    for done in range(updates):
        while len(queue) < min(64, len(texts)):
            queue = np.concatenate([queue, random.permutation(len(texts))])
        pick, queue = queue[:64], queue[64:]
        part, shown = steps[:, pick].copy(), mask[:, pick].copy()
        for i in np.flatnonzero(random.random(len(pick)) < 0.2):
            cut = int(random.integers(4, SPAN))
            part[cut:, i], shown[cut:, i] = 0, 0
        _, grads = _gradients(weights, part, shown, target[pick])
        rate = 0.02 * (1 - done / updates) + 0.002
        for name, grad in grads.items():
            first, second = moment[name]
            grad = np.clip(grad, -1, 1)
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            step = first / (1 - 0.9 ** (done + 1)) / (np.sqrt(second / (1 - 0.99 ** (done + 1))) + 1e-8)
            weights[name] -= (rate * step).astype(np.float32)
    return Model(names, weights)


def labelled_windows(
    docs: DataFrame, text_col: str, label_col: str, id_col: str, cells: int, seed: int
) -> DataFrame:
    """At most ``cells`` windows of ``SPAN`` characters of each label, from all rows.

    Rows fall into cells by a hash of the id; each (label, cell) keeps the row of the least
    hash, a partial aggregate that no frequent label can make large. The place of the window
    within the text also follows from the hash.
    """
    text = F.lower(F.col(text_col))
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.length(text))
    place = F.pmod(order, F.greatest(F.length(text) - SPAN, F.lit(0)) + 1).cast("int") + 1
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(label_col).alias("label"), F.pmod(F.xxhash64(order), F.lit(cells)).alias("cell"),
        F.struct(order.alias("order"), F.substr(text, place, F.lit(SPAN)).alias("window")).alias("row"))
    return rows.groupBy("label", "cell").agg(F.min("row").alias("row")).select("label", "cell", "row.window")


def train_language_model(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
    cells: int = 512, max_labels: int = 64, updates: int = 320, seed: int = 7,
) -> Model | None:
    """Fit the network on a bounded sample: ``cells`` windows for each of the ``max_labels``
    most frequent labels. None when no row has a label and a letter."""
    labels = docs.filter(F.col(label_col).isNotNull()).groupBy(label_col).count()
    top = [row[0] for row in labels.orderBy(F.desc("count"), label_col).limit(max_labels).collect()]
    if not top:
        return None
    sample = labelled_windows(docs.filter(F.col(label_col).isin(top)), text_col, label_col, id_col, cells, seed)
    rows = sorted(tuple(row) for row in sample.collect())
    if not rows:
        return None
    return fit_network([row[2].encode() for row in rows], [row[0] for row in rows], updates, seed)


def pooled(model: Model, column: pa.Array) -> np.ndarray:
    """Mean over all byte positions of each text of the label probabilities; zeros if empty."""
    data, offsets = string_buffers(column)
    sizes = np.diff(offsets)
    counts = -(-sizes // SPAN)
    row = np.repeat(np.arange(len(sizes)), counts)
    ahead = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][row] + ahead * SPAN
    length = np.minimum(SPAN, offsets[1:][row] - begin)
    w = model.weights
    sums = np.zeros((len(sizes), len(model.labels)))
    for at in range(0, len(row), WINDOWS):
        part = slice(at, at + WINDOWS)
        shown = np.arange(SPAN)[:, None] < length[part]
        places = np.minimum(begin[part] + np.arange(SPAN)[:, None], len(data) - 1)
        steps = np.where(shown, data[places], 0).astype(np.intp)
        ahead_states = _run(w["xf"], w["uf"], w["nf"], steps, range(SPAN))
        back_states = _run(w["xb"], w["ub"], w["nb"], steps, range(SPAN - 1, -1, -1))
        total = np.zeros((len(model.labels), steps.shape[1]), np.float32)
        for t in range(SPAN):
            scores = w["v"][:, :HIDDEN] @ ahead_states[t] + w["v"][:, HIDDEN:] @ back_states[t]
            scores += w["c"]
            scores -= scores.max(axis=0)
            np.exp(scores, out=scores)
            scores *= shown[t] / scores.sum(axis=0)
            total += scores
        for label in range(len(model.labels)):
            sums[:, label] += np.bincount(row[part], total[label], len(sizes))
    return sums / np.maximum(sizes, 1)[:, None]


def _predict(columns: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    names = np.array(model.labels, dtype=object)
    for column in columns:
        shares = pooled(model, column)
        best = shares.argmax(axis=1)
        yield pa.StructArray.from_arrays(
            [pa.array(names[best], pa.string()), pa.array(np.clip(shares.max(axis=1), 0.0, 1.0))],
            ["lang_pred", "score"])


@inner_names("_found")
def identify_language(
    docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = ""
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (each after ``prefix``): the label, and its mean
    probability over all bytes.

    Whole texts are read, whatever their length, in windows that run side by side. Null and
    texts without a letter give ``und`` and 0.0; so does every text when there is no model.
    Equal texts get equal results. Extra columns are kept, but for those with the names of
    the results, which are replaced.
    """
    label, score = f"{prefix}lang_pred", f"{prefix}score"
    docs = make_room(docs, label, score)
    if model is None:
        return docs.withColumns({label: F.lit(UNDETERMINED), score: F.lit(0.0)})

    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _predict(columns, model)

    judge = F.arrow_udf(predict, "lang_pred string, score double")
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("_found", judge(F.lower(F.col(text_col))))
    return found.withColumns({
        label: F.when(has_letter, F.col("_found.lang_pred")).otherwise(UNDETERMINED),
        score: F.when(has_letter, F.col("_found.score")).otherwise(0.0),
    }).drop("_found")
