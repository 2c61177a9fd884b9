"""Best-fit sequence packing with a linear grouping scheme.

Documents are tokenised in one map (distinct white-space words of a batch are encoded once and kept
in a bounded dictionary) and cut into pieces of at most the capacity. The pieces are dealt into
blocks of bounded size by a hash of their row number, and every block is packed on its own:
  1. large lengths are sorted and grouped into equally many pieces a group, each rounded up to the
     largest of its group;
  2. the configurations of these few sizes are optimised as a cutting-stock linear programme by
     column generation (a small dense simplex, priced by a knapsack over the capacity);
  3. whole multiples of the chosen configurations are filled with actual pieces of the groups;
  4. what is left, and all small pieces, go by decreasing length into the best-fitting sequence.
A block wastes at most one sequence more than a global packing would, so blocks of some thousand
pieces cost next to nothing, and no step sees the whole corpus at once.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _batches, _lineage

CACHE_WORDS = 300_000
#: Pieces a block holds on average.
BLOCK_PIECES = 16_000
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 40
#: Lengths above such a share of the capacity are large; a block keeps the share that needs the fewest sequences. With 1 none is.
LARGE = (1 / 4, 1 / 3, 1 / 2, 1)
MAX_PIVOTS = 400

_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+")
_BREAKS = str.maketrans("\t\n\r", "   ")


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, for a vocabulary with word ends.

    No token of such a vocabulary spans white space, so a text's ids are those of its words in
    turn. A text of ASCII and common Latin letters is cut into the parts that the vocabulary's own
    pattern finds, and the parts not known yet are encoded together; the words of any other text go
    to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(tokenizer_file)
        # For parts, which are normalised and cut already; both share the model in memory.
        self.bare = Tokenizer(self.tok.model)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}

    def _cut(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.bare.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._whole(words)
        data, cuts = ids.tobytes(), [0, *(stops * 4).tolist()]
        return {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}

    @staticmethod
    def _joined(known: dict[str, bytes], cut: list[list[str]], learn) -> list[bytes]:
        fresh = set().union(*cut).difference(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = set().union(*cut)
        if fresh:
            known.update(learn(list(fresh)))
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        parts = iter(self._joined(self.parts, [_PARTS.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p], self._cut))
        words = iter(self._joined(self.words, [t.translate(_BREAKS).split(" ") for t, p in zip(texts, plain, strict=True) if not p], self._whole))
        return [next(parts) if p else next(words) for p in plain]


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def _cutter(tokenizer_file: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_file).encode, np.array([end_id], "<u4").tobytes()
        for batch in _batches.slices(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(id_col).to_pylist(), encode(_batches.texts(batch, text_col)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, x in zip(cols, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(arrays, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row; null texts are empty."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(_cutter(tokenizer_file, end_id, capacity, id_col, text_col, with_ids), schema)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the most worth that fits the capacity."""
    best, picks = np.zeros(capacity + 1), []
    order = [i for i in range(len(sizes)) if worth[i] > 1e-12]
    for _ in range(capacity // int(sizes.min())):
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for i in order:
            s = int(sizes[i])
            value = best[: capacity + 1 - s] + worth[i]
            better = value > more[s:] + 1e-12
            more[s:][better] = value[better]
            pick[s:][better] = i
        picks.append(pick)
        if np.array_equal(more, best):
            break
        best = more
    config, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if (i := int(pick[room])) >= 0:
            config[i] += 1
            room -= int(sizes[i])
    return float(best[capacity]), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole multiples of configurations that an optimal fractional packing of the sizes uses."""
    k = len(sizes)
    basis, cost = np.diag((capacity // sizes).astype(float)), np.ones(k)
    for _ in range(MAX_PIVOTS):
        inverse = np.linalg.inv(basis)
        x, dual = inverse @ demand, cost @ inverse
        if dual.min() < -1e-9:  # cover more than is asked for
            column, price = np.zeros(k), 0.0
            column[int(dual.argmin())] = -1
        else:
            value, column = _best_configuration(sizes, dual, capacity)
            price = 1.0
            if value <= 1 + 1e-7:
                break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave], cost[leave] = column, price
    x = np.linalg.solve(basis, demand)
    return [(int(n + 1e-9), basis[:, j]) for j, n in enumerate(x) if cost[j] > 0 and n >= 1 - 1e-9]


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths from 1 to the capacity."""
    return min((_pack(lengths, capacity, share) for share in LARGE), key=lambda found: found[0].max(initial=-1))


def _pack(lengths: np.ndarray, capacity: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(lengths)
    sequence, offset, filled = np.full(n, -1), np.zeros(n, np.int64), []
    full = np.flatnonzero(lengths == capacity)
    sequence[full] = np.arange(len(full))
    filled = [capacity] * len(full)
    order = np.argsort(-lengths, kind="stable")
    large = order[(lengths[order] > capacity * share) & (lengths[order] < capacity)]
    if len(large):
        groups = [g.tolist() for g in np.array_split(large, min(GROUPS, len(large)))]
        tops: dict[int, list[int]] = {}
        for g in groups:  # groups with the same largest length are one size
            tops.setdefault(int(lengths[g[0]]), []).extend(g)
        sizes, members = np.array(list(tops)), [g[::-1] for g in tops.values()]
        for times, config in configurations(sizes, np.array([len(g) for g in members], float), capacity):
            for _ in range(times):
                at = 0
                for i in np.flatnonzero(config > 0):
                    for _ in range(int(config[i])):
                        if members[i]:
                            one = members[i].pop()
                            sequence[one], offset[one] = len(filled), at
                            at += int(lengths[one])
                if at:
                    filled.append(at)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for s, used in enumerate(filled):
        if used < capacity:
            rooms[capacity - used].append(s)
            mask |= 1 << (capacity - used)
    for one in order[sequence[order] < 0].tolist():
        size = int(lengths[one])
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            s = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, s = capacity, len(filled)
            filled.append(0)
        sequence[one], offset[one] = s, filled[s]
        filled[s] += size
        if room > size:
            rooms[room - size].append(s)
            mask |= 1 << (room - size)
    return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int = 4096, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset.

    `pieces` must give the same rows in the same partitions whenever it is computed (a checkpoint
    does): a piece's block comes from its row number, so that repeated or null ids spread as well.
    """
    blocks = max(1, -(-pieces.count() // block_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if "ids" in pieces.columns else [])]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        sequence, offset = pack(pdf["length"].to_numpy(np.int64), capacity)
        return pdf[names].assign(sequence_id=int(pdf["_block"].iloc[0]) * 2**32 + sequence, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(names).schema) + ", sequence_id bigint, offset bigint"
    rows = pieces.select(*names, F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    return rows.groupBy("_block").applyInPandas(one, schema)


def best_fit_packing(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all rows of `docs` into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).
    Only documents longer than the capacity are cut. Null and empty texts are the end id alone;
    a null id stays null; repeated rows are packed each; an empty table gives no rows; other columns
    are not read.
    """
    pieces = token_pieces(docs, tokenizer_file, end_id, capacity, id_col, text_col, with_ids)
    return pack_pieces(_lineage.cut(pieces), capacity)
