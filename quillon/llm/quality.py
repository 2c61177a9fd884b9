"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages: its lines, long ones cut into stretches. Every passage is encoded
by what its bytes are made of (shares of character classes, word and sentence shape, repetition in
the document). A hidden layer turns a passage into a representation, gated attention weighs the
passages, and a logistic layer scores the weighted representation. Weights are learnt from document
labels only, with numpy on the driver, from a sample whose bound is a parameter; scoring is one map
over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import _batches

#: At most so many labelled documents are learnt from.
TRAINING_DOCUMENTS = 6_000
#: Bytes of a passage, and of the texts encoded at once.
PASSAGE_BYTES = 600
CHUNK_BYTES = 500_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 128, 0.01, 1e-4
THRESHOLD = 0.3

# Byte classes: lower, upper, digit, white space, then marks on their own, other ASCII, beyond ASCII.
_MARKS = ".,;:!?|#$%&*<>/\\\"'()[]{}=_-@+~^"
_CLASS = np.full(256, 4 + len(_MARKS), np.uint8)
_CLASS[128:] = 5 + len(_MARKS)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3
for _k, _c in enumerate(_MARKS.encode()):
    _CLASS[_c] = 4 + _k
_CLASSES = 6 + len(_MARKS)
#: Pairs of neighbouring kinds: word-like, capital, space, mark.
_KIND = np.full(_CLASSES, 3, np.uint8)
_KIND[[0, 2, _CLASSES - 1]], _KIND[1], _KIND[3] = 0, 1, 2
FEATURES = _CLASSES + 16 + 6


def encode(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (1 at least)."""
    data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    lengths = np.array([len(b) + 1 for b in raws])
    doc_start = np.append(0, np.cumsum(lengths)[:-1])
    line_start = np.union1d(doc_start, np.flatnonzero(data[:-1] == 10) + 1)
    line_length = np.diff(np.append(line_start, len(data)))
    cuts = -(-line_length // PASSAGE_BYTES)
    start = np.repeat(line_start, cuts) + PASSAGE_BYTES * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    length = np.diff(np.append(start, len(data)))
    doc = np.searchsorted(doc_start, start, "right") - 1
    # Empty passages go, but for the first of a text.
    keep = (length > 1) | np.isin(start, doc_start)
    n = len(start)
    owner = np.repeat(np.arange(n), length)
    kinds = _CLASS[data]
    shares = np.bincount(owner * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES) / length[:, None]
    inside = np.ones(len(data), bool)
    inside[doc_start + lengths - 1] = False  # the last byte of a text and the first of the next are no pair
    inside = inside[:-1]
    pair = (_KIND[kinds[:-1]] * 4 + _KIND[kinds[1:]])[inside]
    shape = np.bincount(owner[:-1][inside] * 16 + pair, minlength=n * 16).reshape(n, 16) / length[:, None]
    words = 1 + shape[:, 2] * length + shape[:, 6] * length
    crcs = np.add.reduceat((data + np.uint64(1)) * ((np.arange(len(data), dtype=np.uint64) - np.repeat(start.astype(np.uint64), length)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9)), start)
    _, same, times = np.unique(np.stack([doc.astype(np.uint64), crcs]), axis=1, return_inverse=True, return_counts=True)
    variety = np.array([len(set(ws)) / (len(ws) or 1) for ws in (b.split() for b in raws)])
    extra = np.stack([np.log1p(length) / 5, np.log1p(length / words), np.minimum(times[same.ravel()] - 1, 3) * (length > 12), np.log1p(lengths[doc]) / 8, np.log1p(np.bincount(doc, minlength=len(raws))[doc]) / 4, variety[doc]], axis=1)
    features = np.concatenate([np.sqrt(shares), np.sqrt(shape), extra], axis=1).astype(np.float32)
    return features[keep], np.bincount(doc[keep], minlength=len(raws))


class Model:
    """Gated-attention bag classifier; `weights` is a dictionary of small arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, starts = self.w, np.append(0, np.cumsum(bags)[:-1])
        x = (x - w["mean"]) / w["scale"]
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (v * u) @ w["q"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), bags))
        a /= np.repeat(np.add.reduceat(a, starts), bags)
        z = np.add.reduceat(a[:, None] * h, starts)
        return 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["c"], -30, 30))), (x, h, v, u, a, z)

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        p, (x, h, v, u, a, z) = self.forward(x, bags)
        starts, d = np.append(0, np.cumsum(bags)[:-1]), (p - y) / len(y)
        dz = np.repeat(d[:, None] * w["o"], bags, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), bags))
        dv, du = de[:, None] * w["q"] * u * (1 - v * v), de[:, None] * w["q"] * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        return {"o": z.T @ d, "c": d.sum(), "q": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": x.T @ dh, "b": dh.sum(0)}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam on mini-batches of bags; with one class only, the score is a smoothed base rate."""
    r = np.random.default_rng(seed)
    prior = (y.sum() + 1) / (len(y) + 2)
    w = {
        "mean": x.mean(0) if len(x) else np.zeros(FEATURES), "scale": x.std(0) + 0.02 if len(x) else np.ones(FEATURES),
        "W": r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "q": r.normal(0, 0.1, GATE), "o": np.zeros(HIDDEN), "c": np.array(np.log(prior / (1 - prior))),
    }
    model = Model(w)
    if len(set(y.tolist())) < 2:
        return model
    starts = np.append(0, np.cumsum(bags))
    m, s, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            step += 1
            for name, g in model.gradient(x[rows], bags[pick], y[pick]).items():
                g = g + DECAY * w[name]
                m[name], s[name] = 0.9 * m[name] + 0.1 * g, 0.999 * s[name] + 0.001 * g * g
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                w[name] = w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
    return model


def _by_bytes(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for end, b in enumerate(raws, 1):
        held += len(b) + 1
        if held >= CHUNK_BYTES or end == len(raws):
            yield start, end
            start, held = end, 0


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _batches.slices(batches):
        raws = _batches.raw(batch, "text")
        for a, b in _by_bytes(raws):
            x, bags = encode(raws[a:b])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(bags)) * FEATURES, pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), lists, batch.column("quality").slice(a, b - a)], names=["doc_id", "x", "quality"])


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> Model:
    """Learn from at most `training_documents` labelled documents, those with the smallest id hashes.

    Rows held out, without an id, or with a quality other than 0 and 1 are not learnt from; of
    several labels of one id the largest counts, of several texts the smallest. Labels, lang, source
    and doc_id are no inputs.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_documents)  # a bounded table
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).mapInArrow(_encoded, "doc_id bigint, x array<float>, quality int")
    table = rows.toArrow().sort_by("doc_id")
    x = table.column("x").combine_chunks()
    bags = np.diff(np.append(0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))) // FEATURES if len(x) else np.zeros(0, np.int64)
    return train(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES), bags, table.column("quality").to_numpy().astype(float))


def _scorer(weights: dict[str, np.ndarray], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights)
        for batch in _batches.slices(batches):
            raws = _batches.raw(batch, text_col)
            found = [model.forward(*encode(raws[a:b]))[0] for a, b in _by_bytes(raws)]
            scores = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns and rows of `docs`, and quality_score from 0 to 1.

    A null text scores as an empty one. A column of that name is replaced.
    """
    docs = docs.drop("quality_score")
    weights = {k: np.asarray(v, np.float32) for k, v in model.w.items()}
    return docs.mapInArrow(_scorer(weights, text_col), T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, training_documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`; predicted is 1 from `threshold` on."""
    model = fit(docs, labels, training_documents)
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
