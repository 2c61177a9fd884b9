import random

import public_tokenizers
import pytest

from quillon.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "a", "   a  b ", "a \n b", "\n\nx", "<s> </s> <unk> <0x0A> ▁x▁▁y", "日本語 テキスト 漢字", "ａｂｃ é é 🙂🙂", "a" * 20, "x" * 5000, "ab" * 3000, " " * 100, "\t\t a\tb\r\n", "\x00a\x00", "thethethe" * 500, "▁", "word▁", None,
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    r = random.Random(1)
    out = list(ODD)
    for letters in ("abcdefgh ", "abcdefghijklmnop", "aeiou \n", "".join(map(chr, range(32, 0x250)))):
        out += ["".join(r.choice(letters) for _ in range(n)) for n in (3, 50, 4000)]
    return out + ["".join(chr(r.randrange(32, 0x3000)) for _ in range(3000))]


def test_counts_as_the_library(spark, library):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens int, n_bytes string").repartition(3)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, MODEL, limit=100).collect()}
    for i, t in rows:
        n = len(library.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), repr((t or "")[:60])


def test_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_SYMBOLS", 16)
    bpe = token_counts.RankMerger(MODEL)
    words = ["▁the", "ing", "▁thing", "a" * 40, "▁" * 9, "\n"]
    assert bpe.counts(words).tolist() == [bpe.counts([w])[0] for w in words]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs, MODEL).collect()) == [("1", 2), ("1", 2), ("None", 2)]
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0
