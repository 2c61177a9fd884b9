"""Log-likelihood of documents under a gated recurrent language model.

Words are counted over all training documents. The most frequent ones are the head: they are dealt
into classes of like mass, and the output softmax is factored into a class and a word of it. All
other words, of any number, are a few tail classes by their form (last byte, bytes beyond ASCII,
length); inside one a word has the share of its count plus one. So the model's size is fixed while
its counts grow with the corpus.

The model is trained on all training documents, in rounds over disjoint parts of them. In a round
every task goes on from the model of the round before with truncated backpropagation over its own
documents; the results are averaged by tokens. It starts from the distribution of the counts, so
that it differs from them only by what it has learnt of contexts.

A batch of documents is dealt into lanes that run in step, a window of steps at a time; a lane holds
whole documents one after the other, and its state goes on from window to window until a document
ends. Scores of a text are therefore those of the whole text, whatever its length.

Counts of the known words, a bounded number of the most frequent, are sent to the tasks. All other
words of a document meet their counts in a join, and only sums come back to its row.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _lineage

#: Words of the factored softmax, words whose counts are sent to the tasks (at most), classes of the head; then
#: numbers of a state, steps of a window at full width (LONGEST times as many at most where few lanes run), lanes.
HEAD, KNOWN, CLASSES = 1_024, 300_000, 16
STATE, WINDOW, LONGEST, LANES, RATE = 16, 16, 8, 1_024, 0.01
#: Tokens of a text that are learnt from in one go.
PIECE = 2_048
#: Rounds as upper ends of the sixteenths of the documents that they learn from: each document is in one.
ROUNDS, SIXTEENTHS = (1, 3, 8, 16), 16
#: Tokens that are dealt into lanes together, and at most where a document is longer than a lane's share; words a task counts together.
BUFFER, BUFFER_MOST, COUNTED, PIECE_BYTES = 1_000_000, 4_000_000, 4_000_000, 8_000_000
#: Models averaged into one on the way to the driver.
AVERAGES = 32
FORMS = 8
END = b""  # the token after the last word of a text; no word is empty
_WORD_BYTE = np.zeros(256, bool)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts (null: none), A-Z in lower case, as bytes; and the text that each stands in.

    Words stand between ASCII white space.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words = cut.flatten().cast(pa.binary())
    of = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    real = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty word
    return (words, of) if real.all() else (words.filter(pa.array(real)), of[real])


def forms(words: pa.Array) -> np.ndarray:
    """Which of the FORMS each word (bytes, none empty) belongs to when it is outside the head."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    high = np.add.reduceat(data[: offsets[-1]] > 127, offsets[:-1], dtype=np.int64) > 0
    return 4 * (np.diff(offsets) > 8) + 2 * high + ~_WORD_BYTE[data[offsets[1:] - 1]]


def form(word: bytes) -> int:
    return int(forms(pa.array([word], pa.binary()))[0])


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a piece have about PIECE_BYTES bytes, or it is one row."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        nth = np.cumsum(size) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                yield batch.slice(a, z - a)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 7; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


# ---- counts --------------------------------------------------------------------------------------


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, texts = [], 0

    def counted() -> pa.RecordBatch:
        found = pa.chunked_array([*held, pa.array([END], pa.binary())]).value_counts()
        n = found.field("counts").to_numpy().copy()
        n[-1] += texts - 1  # the end, which came last
        return pa.record_batch([found.field("values"), pa.array(n)], names=["word", "n"])

    for piece in pieces(batches, "text"):
        held.append(words_of(piece.column("text"))[0])
        texts += piece.num_rows
        if sum(map(len, held)) > COUNTED:
            yield counted()
            held, texts = [], 0
    if texts:
        yield counted()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word: binary, n) of all texts, an end a text included."""
    return texts.select("text").mapInArrow(_counter, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Known words by falling count, the first `head` of them in the softmax; what is counted of the tail's forms, and of all words."""

    words: list[bytes]  # the end first
    counts: np.ndarray
    head: int
    form_sizes: np.ndarray  # sum of n + 1 over the tail words of a form, and one for all unknown ones
    tokens: int
    distinct: int
    def classes(self) -> np.ndarray:
        """First word of each class of the head, and the head's end: about the same sum of roots of counts in each."""
        share = np.sqrt(np.maximum(self.counts[: self.head], 1)).cumsum()
        nth = np.minimum((share / share[-1] * CLASSES).astype(int), CLASSES - 1)
        return np.append(np.flatnonzero(np.diff(nth, prepend=-1)), self.head)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FORMS, np.int64)
    for batch in batches:
        total += np.bincount(forms(batch.column("word")), batch.column("n").to_numpy() + 1, FORMS).astype(np.int64)
    yield pa.record_batch([pa.array(np.arange(FORMS)), pa.array(total)], names=["form", "n"])


def vocabulary(counts: DataFrame, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """The vocabulary of a computed table of counts; at most `known` of its rows, and one row a size, come to the driver."""
    size = F.floor(F.log2("n") * 16)
    sizes = sorted(map(tuple, counts.groupBy(size.alias("size")).agg(F.count("*"), F.sum("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n, _ in sizes:
        if (total := total + n) > known:
            break
        least = at
    rows = counts.filter((size >= least) | (F.col("word") == F.lit(END))).collect() if least is not None else counts.filter(F.col("word") == F.lit(END)).collect()
    found = sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0])) or [(END, 0)]
    found.sort(key=lambda x: x[0] != END)  # the end comes first, whatever its count
    words, ns = [w for w, _ in found], np.array([n for _, n in found], np.int64)
    forms = {r.form: r.n for r in counts.filter(F.col("word") != F.lit(END)).mapInArrow(_forms, "form bigint, n bigint").groupBy("form").agg(F.sum("n").alias("n")).collect()}
    form_sizes = np.array([forms.get(k, 0) + 1 for k in range(FORMS)], np.int64)
    top = min(head, len(words))
    for w, n in zip(words[1:top], ns[1:top].tolist(), strict=True):
        form_sizes[form(w)] -= n + 1
    return Vocabulary(words, ns, top, form_sizes, sum(n for _, _, n in sizes), sum(n for _, n, _ in sizes))


# ---- the model -----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """A gated recurrent unit over tokens 0 .. head + FORMS - 1 (head words, then tail forms).

    `w` holds X (what an input adds to the update, reset and candidate gates; the last column is the
    start of a text), U (the same for the state), C, c (state to classes) and W, b (state to words of
    their class). `starts` are the first words of the classes. Numbers of a state or gate are rows,
    tokens columns, so that every step works on whole rows.
    """

    def __init__(self, starts: np.ndarray, w: dict[str, np.ndarray]):
        self.starts, self.w = starts, w
        self.head, self.n = int(starts[-1]), len(starts) - 1
        self.class_of = np.append(np.repeat(np.arange(self.n), np.diff(starts)), self.n + np.arange(FORMS)).astype(np.uint8)

    @classmethod
    def of(cls, v: Vocabulary, seed: int = 11) -> Model:
        """The model of the counts alone: biases give every class and word its share; states do not matter yet."""
        r, starts = np.random.default_rng(seed), v.classes()
        n = np.maximum(v.counts[: v.head], 0) + 1.0
        mass = np.append(np.add.reduceat(n, starts[:-1]), v.form_sizes)
        f = np.float32
        w = {
            "X": r.normal(0, 0.1, (3 * STATE, v.head + FORMS + 1)).astype(f), "U": r.normal(0, STATE**-0.5, (3 * STATE, STATE)).astype(f),
            "C": np.zeros((len(mass), STATE), f), "c": np.log(mass / mass.sum()).astype(f), "W": np.zeros((v.head, STATE), f), "b": np.log(n).astype(f),
        }
        return cls(starts, w)

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States (steps, numbers, lanes) after each step of inputs (steps, lanes); `fresh` marks where a text starts."""
        (steps, lanes), s, u, table = x.shape, STATE, self.w["U"], self.w["X"]
        gates = np.empty((steps, 3 * s, lanes), np.float32)
        before, out, pre = (np.empty((steps, s, lanes), np.float32) for _ in range(3))
        anew = [np.flatnonzero(row) for row in fresh]
        for t in range(steps):
            old, now = before[t], gates[t]
            old[:] = h
            if len(anew[t]):
                old[:, anew[t]] = 0
            table.take(x[t], axis=1, out=now, mode="clip")
            a = u @ old
            zr, n = now[: 2 * s], now[2 * s :]
            zr += a[: 2 * s]
            _sigmoid(zr)
            pre[t] = a[2 * s :]
            n += np.multiply(zr[s:], a[2 * s :], out=a[: s])
            np.tanh(n, out=n)
            h = np.subtract(old, n, out=out[t])
            h *= zr[:s]
            h += n
        return out, (before, gates, pre)

    def output(self, h: np.ndarray, y: np.ndarray, gradient: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray | None]:
        """ln of the probability of each target from its state (a column), and the gradients of minus their sum if asked for."""
        w, which = self.w, self.class_of[y]
        order = np.argsort(which, kind="stable")
        h, y, which = h.take(order, axis=1), y[order], which[order]  # class by class
        ends = np.searchsorted(which, np.arange(self.n + 1))
        score = w["C"] @ h
        score += w["c"][:, None]
        found, p, total = _log_share(score, which)
        grads, dh = {}, None
        if gradient:
            p /= total
            p[which, np.arange(len(y))] -= 1
            dh = w["C"].T @ p
            grads = {"C": p @ h.T, "c": p.sum(1), "W": np.zeros_like(w["W"]), "b": np.zeros_like(w["b"])}
        for k in range(self.n):
            a, z, at = self.starts[k], self.starts[k + 1], slice(ends[k], ends[k + 1])
            if z - a < 2 or at.start == at.stop:
                continue
            right = y[at] - a
            score = w["W"][a:z] @ h[:, at]
            score += w["b"][a:z, None]
            more, p, total = _log_share(score, right)
            found[at] += more
            if gradient:
                p /= total
                p[right, np.arange(len(right))] -= 1
                dh[:, at] += w["W"][a:z].T @ p
                grads["W"][a:z], grads["b"][a:z] = p @ h[:, at].T, p.sum(1)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return found[back].astype(np.float64), grads, None if dh is None else dh.take(back, axis=1)

    def back(self, x: np.ndarray, fresh: np.ndarray, kept: tuple, dout: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of X and U from those of the states (steps, numbers, lanes), back to the start of the window."""
        before, gates, pre = kept
        (steps, lanes), s, ut = x.shape, STATE, np.ascontiguousarray(self.w["U"].T)
        dx, da = np.empty((3 * s, steps, lanes), np.float32), np.empty((3 * s, lanes), np.float32)
        du, dh = np.zeros_like(self.w["U"]), np.zeros((s, lanes), np.float32)
        anew = [np.flatnonzero(row) for row in fresh]
        for t in range(steps - 1, -1, -1):
            dh += dout[t]
            z, r, n = gates[t, :s], gates[t, s : 2 * s], gates[t, 2 * s :]
            rest = 1 - z
            dn = dh * rest
            dn *= 1 - n * n
            np.multiply(dn, r, out=da[2 * s :])
            np.multiply(dh, before[t] - n, out=da[:s])
            da[:s] *= z
            da[:s] *= rest
            np.multiply(da[2 * s :], pre[t], out=da[s : 2 * s])
            da[s : 2 * s] *= 1 - r
            dx[: 2 * s, t], dx[2 * s :, t] = da[: 2 * s], dn
            du += da @ before[t].T
            dh *= z
            dh += ut @ da
            if len(anew[t]):
                dh[:, anew[t]] = 0
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        ids, first = np.unique(flat[order], return_index=True)
        inputs = np.zeros_like(self.w["X"])
        for row, values in zip(inputs, dx.reshape(3 * s, -1), strict=True):
            row[ids] = np.add.reduceat(values[order], first)
        return {"X": inputs, "U": du}


def columns(x: np.ndarray) -> np.ndarray:
    """(steps, numbers, lanes) as (numbers, steps x lanes)."""
    return np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(x.shape[1], -1)


def _log_share(score: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln of the share of row `which` of each column in the exponentials, which are left in the place of the scores, and their sums."""
    score -= score.max(0)
    found = score[which, np.arange(len(which))]
    np.exp(score, out=score)
    total = score.sum(0)
    return found - np.log(total), score, total


class Lanes:
    """Texts (arrays of tokens) dealt into lanes: the longest first, each to the lane that is shortest so far."""

    def __init__(self, texts: list[np.ndarray], start: int, most: int = LANES):
        sizes = np.array([len(t) for t in texts])
        width = max(1, min(most, len(texts), int(sizes.sum()) // (4 * WINDOW) + 1))
        lanes: list[list[int]] = [[] for _ in range(width)]
        heap = [(0, k) for k in range(width)]
        for i in np.argsort(-sizes, kind="stable").tolist():
            held, k = heap[0]
            lanes[k].append(i)
            heapq.heapreplace(heap, (held + int(sizes[i]), k))
        held_by = {k: held for held, k in heap}
        lanes = [lanes[k] for k in sorted(range(width), key=lambda k: -held_by[k])]
        self.order = np.array([i for lane in lanes for i in lane], np.int64)
        self.y = np.concatenate([texts[i] for i in self.order])
        self.ends = np.cumsum(sizes[self.order])
        self.first = self.ends - sizes[self.order]
        self.lengths = np.array([sum(int(sizes[i]) for i in lane) for lane in lanes])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.x = np.append(start, self.y[:-1])
        self.x[self.first] = start
        self.fresh = np.zeros(len(self.y), bool)
        self.fresh[self.first] = True

    def windows(self) -> Iterator[np.ndarray]:
        """Places of the tokens of each window (steps x lanes still running), -1 behind a lane's end.

        Where few lanes still run, a window has more steps, so that it holds about as many tokens.
        """
        at = 0
        while at < self.lengths[0]:
            running = int((self.lengths > at).sum())
            steps = min(LONGEST * WINDOW, max(WINDOW, WINDOW * LANES // running))
            left = self.lengths[:running] - at
            place = np.arange(steps)[:, None]
            yield np.where(place < left, self.starts[:running] + at + place, -1)
            at += steps

    def by_text(self, per_token: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order))
        out[self.order] = np.add.reduceat(per_token, self.first)
        return out


def score_texts(model: Model, texts: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """ln of the probability of each text (tokens of the model, none empty); the state goes on through all windows of a text."""
    dealt = Lanes(texts, model.w["X"].shape[1] - 1, lanes)
    found, h = np.zeros(len(dealt.y)), np.zeros((STATE, len(dealt.lengths)), np.float32)
    for places in dealt.windows():
        real = (places >= 0).ravel()
        out, _ = model.run(dealt.x[places], dealt.fresh[places], h[:, : places.shape[1]])
        h = out[-1]
        at = places.ravel()[real]
        found[at] = model.output(columns(out)[:, real], dealt.y[at])[0]
    return dealt.by_text(found)


def learn_texts(model: Model, texts: list[np.ndarray], moments: dict, rate: float = RATE, lanes: int = LANES) -> None:
    """One pass of truncated backpropagation over the texts, a step of Adam a window; changes the model and its moments.

    Here a text of more than PIECE tokens is learnt from as several, so that lanes end together; scores are of whole texts.
    """
    pieces = [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]
    dealt = Lanes(pieces, model.w["X"].shape[1] - 1, lanes)
    h = np.zeros((STATE, len(dealt.lengths)), np.float32)
    for places in dealt.windows():
        real = (places >= 0).ravel()
        x, fresh = dealt.x[places], dealt.fresh[places]
        out, kept = model.run(x, fresh, h[:, : places.shape[1]])
        h = out[-1]
        _, grads, dh = model.output(columns(out)[:, real], dealt.y[places.ravel()[real]], gradient=True)
        dout = np.zeros((STATE, places.size), np.float32)
        dout[:, real] = dh
        grads |= model.back(x, fresh, kept, dout.reshape(STATE, *x.shape).transpose(1, 0, 2))
        n = int(real.sum())
        moments["steps"] = step = moments.get("steps", 0) + 1
        fix = math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for name, g in grads.items():
            g /= n
            m, s = moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            g *= g
            s += 0.001 * (g - s)
            np.sqrt(s, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= rate * fix
            model.w[name] -= g


# ---- tasks ---------------------------------------------------------------------------------------


class Reader:
    """Turns texts into tokens of the model, and gives the counts of their known words."""

    def __init__(self, v: Vocabulary, known: int | None = None):
        self.words, self.head = pa.array(v.words[:known], pa.binary()), v.head
        self.log_count, self.seen = np.log10(v.counts + 1.0), v.counts > 0
        self.log_size = np.log10(v.form_sizes.astype(float))

    def read(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, pa.Array]:
        """The tokens of each text with its end; the number of each known word (-1 for others) and the text it stands in; and all words."""
        words, of = words_of(texts)
        ids = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        out = np.zeros(len(words) + len(texts), np.int32)  # token 0 is the end
        out[np.arange(len(words)) + of] = np.where((ids >= 0) & (ids < self.head), ids, self.head + forms(words))
        ends = np.bincount(of, minlength=len(texts)).cumsum() + np.arange(1, len(texts) + 1)
        return np.split(out, ends[:-1]), ids, of, words


@lru_cache(maxsize=2)
def _reader(shared, known: int | None = None) -> Reader:
    return Reader(pickle.loads(zlib.decompress(shared.value)), known)  # our own vocabulary, see `log_likelihood`


def _full(texts: list[np.ndarray]) -> bool:
    """Whether texts are enough to be dealt into lanes: a lane's share is as long as the longest, or the bound is reached."""
    total = sum(map(len, texts))
    return total >= min(BUFFER_MOST, max(BUFFER, max(map(len, texts)) * LANES))


def _packed(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(w[k], np.float32).tobytes() for k in sorted(w))


def _unpacked(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _trainer(shared, starts: np.ndarray, weights: dict[str, np.ndarray], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, moments, tokens = Model(starts, {k: x.copy() for k, x in weights.items()}), {}, 0
        reader, held = _reader(shared, int(starts[-1])), []

        def learn() -> int:
            learn_texts(model, held, moments, rate)
            return sum(map(len, held))

        for piece in pieces(batches, "text"):
            held += reader.read(piece.column("text"))[0]
            if _full(held):
                tokens += learn()
                held = []
        if held:
            tokens += learn()
        if tokens:
            yield pa.record_batch([pa.array([_packed(model.w)], pa.binary()), pa.array([float(tokens)])], names=["w", "n"])

    return run


def _averager(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mean, total = None, 0.0
    for batch in batches:
        for data, n in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist(), strict=True):
            one, total = np.frombuffer(data, np.float32).astype(np.float64), total + n
            mean = one if mean is None else mean + (one - mean) * (n / total)
    if mean is not None:
        yield pa.record_batch([pa.array([mean.astype(np.float32).tobytes()], pa.binary()), pa.array([total])], names=["w", "n"])


def train(texts: DataFrame, v: Vocabulary, shared) -> Model:
    """The model after one pass over all of `texts` (key: bigint, text), in rounds; AVERAGES models at most reach the driver in each.

    A task's part of a round depends on how the rows are partitioned; so does, a little, the model.
    """
    model, part, from_ = Model.of(v), F.pmod(F.xxhash64("key"), F.lit(SIXTEENTHS)), 0
    for to in ROUNDS:
        rows = texts.filter((part >= from_) & (part < to)).select("text")
        rate = RATE * (1 - from_ / SIXTEENTHS)
        trained = rows.mapInArrow(_trainer(shared, model.starts, model.w, rate), "w binary, n double")
        found = trained.repartition(AVERAGES).mapInArrow(_averager, "w binary, n double").collect()
        if found:
            total = sum(r.n for r in found)
            mean = sum(np.frombuffer(bytes(r.w), np.float32).astype(np.float64) * (r.n / total) for r in found)
            model = Model(model.starts, _unpacked(mean.astype(np.float32).tobytes(), model.w))
        from_ = to
    return model


_SCORED = ["row", "id", "learn", "n_tokens", "n_known", "base", "score", "word", "n"]


def _scorer(shared, starts: np.ndarray, weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader, texts, rows = Model(starts, weights), _reader(shared), [], []

        def scored() -> Iterator[pa.RecordBatch]:
            score = score_texts(model, texts) / math.log(10)
            at = 0
            for piece, known, base, tail in rows:
                n = piece.num_rows
                part = slice(at, at + n)
                sizes = np.array([len(t) for t in texts[part]], np.int64)
                own = [b" %d" % r for r in piece.column("row").to_pylist()]  # no word holds a space: this meets no count and spreads over the join
                yield pa.record_batch([*(piece.column(c) for c in _SCORED[:3]), *map(pa.array, (sizes, known, base, score[part] + tail)), pa.array(own, pa.binary()), pa.nulls(n, pa.int64())], names=_SCORED)
                at += n

        for piece in pieces(batches, "text"):
            found, ids, of, words = reader.read(piece.column("text"))
            n, is_known = piece.num_rows, ids >= 0
            log_count = np.where(is_known, reader.log_count[ids], 0.0)
            tail = (ids < 0) | (ids >= reader.head)
            inside = np.where(tail, log_count, 0.0)
            inside[tail] -= reader.log_size[forms(words)[tail]]
            by_text = lambda x: np.bincount(of, x, n)
            seen = by_text(is_known & reader.seen[ids]).astype(np.int64) + int(reader.seen[0])
            rows.append((piece.select(_SCORED[:3]), seen, by_text(log_count) + reader.log_count[0], by_text(inside)))
            texts += found
            # Words whose counts are elsewhere, once a text.
            other = ~is_known
            pairs = pa.table({"of": of[other], "word": words.filter(pa.array(other))}).group_by(["of", "word"]).aggregate([([], "count_all")])
            at = pairs.column("of").combine_chunks()
            none = [pa.nulls(len(at), k) for k in (piece.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.record_batch([piece.column("row").take(at), *none, pairs.column("word").combine_chunks(), pairs.column("count_all").combine_chunks()], names=_SCORED)
            if _full(texts):
                yield from scored()
                texts, rows = [], []
        if texts:
            yield from scored()

    return run


def log_likelihood(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, known: int = KNOWN) -> tuple[DataFrame, Vocabulary]:
    """(id, held_out, n_tokens, n_known, base_score, score) of every row of `docs`, and the vocabulary of those it learns from.

    `learn` says of a row whether it is learnt from; null is no. base_score is the sum of log10
    ((c + 1) / (N + V + 1)) over the tokens, score the model's log10 probability. A null text is
    empty: its only token is the end. Rows of one id are rows of their own. Without a row to learn
    from every count is 0, and without rows the result is empty.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = rows.filter("learn")
    counts = _lineage.table(word_counts(own))
    v = vocabulary(counts, head, known)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(v), 1))  # at most `known` words
    model = train(own.select(F.xxhash64("id", F.length("text")).alias("key"), "text"), v, shared)
    kind = docs.schema[id_col].dataType.simpleString()
    parts = rows.mapInArrow(_scorer(shared, model.starts, model.w), f"row bigint, id {kind}, learn boolean, n_tokens bigint, n_known bigint, base double, score double, word binary, n bigint")
    parts = parts.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("c", F.lit(0))  # the row of a text itself has no n
    one = [F.max(x).alias(x) for x in ("id", "learn", "n_tokens", "n_known", "base", "score")]
    sums = parts.groupBy("row").agg(*one, F.sum(n * F.log10(c + 1)).alias("rest"), F.sum(F.when(c > 0, n).otherwise(0)).alias("more"))
    base = F.col("base") + F.col("rest") - F.col("n_tokens") * F.lit(math.log10(v.tokens + v.distinct + 1))
    known_words = (F.col("n_known") + F.col("more")).alias("n_known")
    return sums.select(F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", known_words, base.alias("base_score"), (F.col("score") + F.col("rest")).alias("score")), v
