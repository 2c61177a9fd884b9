import random
import zlib

import numpy as np
import public_tokenizers

from quillon.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def odd():
    r = random.Random(2)
    out = ["", " ", "\n", "a", "  a  b ", "don't we'll I'VE <|endoftext|>x<|startoftext|> a<|endoftext|>", "Σίσυφος ΣΑΣ ΟΔΟΣ", "é Éa ́", "日本語 　 テキ", "\x1c\x1da!\x1f b\x85c\xa0d", "🙂🙂 ı İ ǅ ß ẞ µª", "\"'s'S 123 12a3", "ＡＢＣ", "a​b", "!?" * 500, "x" * 3000, None]
    return out + ["".join(chr(r.randrange(32, 0x3000)) for _ in range(2000)) for _ in range(3)] + [" ".join(r.choice(["Word", "tion.", "12", "été", "don't"]) for _ in range(9000))]


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "tok"):
        ids_of.tok = Tokenizer.from_file(FILE)
    return np.array([*ids_of.tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts, capacity=4096):
    """Pieces are those of the library's ids, and sequences are gapless and not over the capacity."""
    want = {(i, k): ids_of(t)[k * capacity : (k + 1) * capacity] for i, t in enumerate(texts) for k in range(-(-len(ids_of(t)) // capacity))}
    assert {(r.doc_id, r.piece) for r in rows} == set(want)
    places = {}
    for r in rows:
        w = want[(r.doc_id, r.piece)]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(w), zlib.crc32(w.tobytes()))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(places)


def test_ids_as_the_library():
    enc = packing.WordEncoder(FILE)
    texts = [t or "" for t in odd()]
    for t, b in zip(texts, enc.encode(texts), strict=True):
        assert b == ids_of(t)[:-1].tobytes(), repr(t[:60])


def test_round_trip(spark):
    texts = odd()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    check(packing.best_fit_packing(docs, FILE).collect(), texts)
    some = packing.best_fit_packing(docs, FILE, capacity=64, with_ids=True).collect()
    check(some, texts, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in some)


def test_small_blocks():
    """The grouping serves blocks of any size, and never needs more sequences than best fit alone."""
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 30, 100):
        for capacity in (10, 64, 4096):
            lengths = r.integers(1, capacity + 1, n)
            sequence, offset = packing.pack(lengths, capacity)
            used = np.bincount(sequence, lengths)
            assert used.min() > 0 and used.max() <= capacity
            for s in range(len(used)):
                own = np.flatnonzero(sequence == s)
                own = own[np.argsort(offset[own])]
                assert offset[own].tolist() == np.append(0, np.cumsum(lengths[own]))[:-1].tolist()
            assert len(used) <= packing._pack(lengths, capacity, 1)[0].max() + 1


def test_few_sequences():
    r = np.random.default_rng(0)
    for make in (lambda: r.integers(1, 4097, 3000), lambda: np.full(1000, 1500), lambda: r.integers(1300, 1400, 2000), lambda: np.minimum(4096, r.lognormal(6, 1, 5000).astype(int) + 1), lambda: np.array([4096, 4096, 1])):
        lengths = make()
        sequence, offset = packing.pack(lengths, 4096)
        used = np.bincount(sequence, weights=lengths)
        assert used.max() <= 4096 and (used > 0).all()
        order = np.argsort(-lengths)
        bins = []
        for n in lengths[order].tolist():  # best-fit decreasing as a yardstick
            fits = [i for i, room in enumerate(bins) if room >= n]
            if fits:
                bins[min(fits, key=bins.__getitem__)] -= n
            else:
                bins.append(4096 - n)
        assert len(used) <= len(bins) * 1.02 + 1
    assert packing.pack(np.zeros(0, np.int64), 4096)[0].size == 0


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id long, text string")
    rows = packing.best_fit_packing(docs, FILE).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("3", 1), ("None", 2), ("None", 2)]
    assert packing.best_fit_packing(docs.limit(0), FILE).count() == 0


def test_blocks(spark):
    texts = ["word " * (i % 60) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    pieces = packing._lineage.cut(packing.token_pieces(docs, FILE, capacity=64))
    check(packing.pack_pieces(pieces, 64, block_pieces=40).collect(), texts, 64)
