"""Exact subword token counts by rank-synchronous array merging.

The vocabulary is a SentencePiece BPE model. Every text is cut into pre-tokens that no piece can
span (a piece holds the space mark only at its start, or nothing else). The distinct pre-tokens of
a batch that are not known yet are held as one ragged numpy array of symbols with one sequence id
per symbol; each round finds the lowest merge rank of every sequence and applies that pair in all
sequences at the same time, until no pair is left; the surviving symbols are counted, characters
outside the vocabulary as their UTF-8 bytes. A bounded dictionary in the worker keeps the counts of
pre-tokens seen before. There is no shuffle: the operator is one map over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import _batches

SPACE = "▁"
#: Pre-tokens kept in a worker; beyond that the dictionary starts anew.
CACHE_WORDS = 300_000
#: Symbols merged in one ragged array.
CHUNK_SYMBOLS = 400_000
_NONE = np.int64(1) << 60


class RankMerger:
    """Counts the symbols that survive the merges of a SentencePiece BPE model."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only a BPE model with the identity normaliser, a leading space mark and kept white space is supported")
        plain = [p for p in model.pieces if p.type in (1, 5)]
        if any(p.type == 4 for p in model.pieces) or any(SPACE in p.piece.lstrip(SPACE) for p in plain):
            raise ValueError("user-defined pieces, or pieces with a space mark inside, are not supported")
        # Equal scores share a rank: the leftmost pair of a sequence then goes first.
        scores = sorted({p.score for p in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {p.piece: rank_of[p.score] for p in plain}
        symbols = {s: i for i, s in enumerate(sorted(rank.keys() | {c for p in rank for c in p}))}
        self.chars = {c: i for c, i in symbols.items() if len(c) == 1}
        self.known = {c for c in self.chars if c in rank}
        self.width = len(symbols) + 1
        keys, ranks, made = [], [], []
        for piece, r in rank.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(r)
                    made.append(symbols[piece])
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order], np.array(made, np.int64)[order]
        self.fallback = bool(model.trainer_spec.byte_fallback)
        self.newline_breaks = "\n" not in self.chars

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        out, start, held = np.zeros(len(words), np.int64), 0, 0
        for end, word in enumerate(words, 1):
            held += len(word)
            if held >= CHUNK_SYMBOLS or end == len(words):
                out[start:end] = self._merge(words[start:end])
                start, held = end, 0
        return out

    def _merge(self, words: list[str]) -> np.ndarray:
        get = self.chars.get
        text = "".join(words)
        sym = np.fromiter((get(c, -1) for c in text), np.int64, len(text))
        seq = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # What a symbol counts for in the end: 1, or its bytes where it is a character without a piece.
        if self.fallback:
            weight = np.fromiter((1 if c in self.known else len(c.encode("utf-8", "surrogatepass")) for c in text), np.int64, len(text))
        else:
            weight = np.ones(len(text), np.int64)
        total = np.zeros(len(words), np.int64)
        rank, made = np.full(len(sym), _NONE), np.full(len(sym), -1)
        self._refresh(sym, seq, rank, made, np.arange(len(sym)))
        while True:
            low = np.full(len(words), _NONE)
            heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low[seq[heads]] = np.minimum.reduceat(rank, heads)
            live = low[seq] < _NONE
            if not live.all():  # finished sequences leave the array
                np.add.at(total, seq[~live], weight[~live])
                sym, seq, weight, rank, made = (x[live] for x in (sym, seq, weight, rank, made))
                if not len(sym):
                    return total
            best = np.flatnonzero(rank == low[seq])
            # All places of the lowest pair at once; of a run of overlapping places, every other one.
            run = np.ones(len(best), bool)
            run[1:] = best[1:] != best[:-1] + 1
            starts = np.flatnonzero(run)
            place = np.arange(len(best)) - np.repeat(starts, np.diff(np.append(starts, len(best))))
            take = best[place % 2 == 0]
            done = self._applied(sym, seq, weight, rank, made, take)
            # Where a new pair would come before the rest, only the leftmost place is merged in this round.
            owner, early = seq[take], np.zeros(len(words), bool)
            for side in (done[-1] - 1, done[-1]):
                ok = side >= 0
                early[owner[ok][done[3][side[ok]] <= low[owner[ok]]]] = True
            early &= np.bincount(owner, minlength=len(words)) > 1
            if early.any():
                first = np.ones(len(best), bool)
                first[1:] = seq[best[1:]] != seq[best[:-1]]
                take = np.union1d(take[~early[owner]], best[first & early[seq[best]]])
                done = self._applied(sym, seq, weight, rank, made, take)
            sym, seq, weight, rank, made, _ = done

    def _applied(self, sym, seq, weight, rank, made, take) -> tuple[np.ndarray, ...]:
        """The arrays after the merges at `take`, and where the new symbols stand in them."""
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        sym, weight = sym.copy(), weight.copy()
        sym[take], weight[take] = made[take], 1
        sym, seq, weight, rank, made = (x[keep] for x in (sym, seq, weight, rank, made))
        at = take - np.arange(len(take))  # one symbol has gone for each merge before
        self._refresh(sym, seq, rank, made, np.concatenate([at, at[at > 0] - 1]))
        return sym, seq, weight, rank, made, at

    def _refresh(self, sym, seq, rank, made, at) -> None:
        """Look up the pairs that start at the places `at`, in place."""
        rank[at], made[at] = _NONE, -1
        at = at[at + 1 < len(sym)]
        at = at[(seq[at] == seq[at + 1]) & (sym[at] >= 0) & (sym[at + 1] >= 0)]
        key = sym[at] * self.width + sym[at + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[found] == key
        at, found = at[hit], found[hit]
        rank[at], made[at] = self.ranks[found], self.made[found]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; a line break that no piece holds stands alone."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.newline_breaks:
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", SPACE + text.replace(" ", SPACE))
        return (SPACE + text).replace(" ", " " + SPACE).replace("\n", " \n ").split(" ")


@lru_cache(maxsize=2)
def merger(model_file: str) -> RankMerger:
    return RankMerger(model_file)


def _counter(model_file: str, id_col: str, text_col: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = merger(model_file), {"": 0}
        for batch in _batches.slices(batches):
            docs = _batches.texts(batch, text_col)
            cut = [bpe.split(t) for t in docs]
            fresh = set().union(*cut).difference(known)
            if fresh:
                if len(known) + len(fresh) > CACHE_WORDS:
                    known = {"": 0}
                    fresh = set().union(*cut).difference(known)
                words = list(fresh)
                known.update(zip(words, bpe.counts(words).tolist(), strict=True))
            get = known.__getitem__
            tokens = [sum(map(get, words)) for words in cut]
            yield pa.record_batch(
                [
                    batch.column(id_col).cast(pa.int64()),
                    pa.array([len(b) for b in _batches.raw(batch, text_col)], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows are
    counted each; other columns are not read. The tokens are those of the model without begin,
    end or other added tokens.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(_counter(model_file, id_col, text_col, limit), schema)
