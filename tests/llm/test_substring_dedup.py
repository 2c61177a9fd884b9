import random
import re

from quillon.llm import substring_dedup as S


def cut(text):
    return [s for s in re.split(r"(?<=[.!?])(?=[ \t])|(?<=[.!?][\"')\]])(?=[ \t])|(?<=\n)", text or "") if s]


def brute(rows):
    """Kept texts: the rules of the operator in plain Python; rows are (id, text) with distinct ids."""
    places = {}
    for d, t in sorted(rows):
        full = [(i, n) for i, s in enumerate(cut(t)) if (n := " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), s).split(" ")).strip()) and (n := re.sub(r"[ \t-\r]+", " ", n).strip(" "))]
        for p in range(len(full)):
            for k, least in S.SPANS:
                run = full[p : p + k]
                if len(run) == k and sum(len(n.split(" ")) for _, n in run) >= least:
                    places.setdefault((k, *(n for _, n in run)), []).append((d, run[0][0], run[-1][0]))
    gone = {}
    for found in places.values():
        first = min(found)
        for d, a, b in found:
            if (d, a) != (first[0], first[1]):
                gone.setdefault(d, set()).update(range(a, b + 1))
    return {d: ("".join(s for i, s in enumerate(cut(t)) if i not in gone.get(d, ())), sorted(gone.get(d, ()))) for d, t in rows}


def test_same_as_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 5)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice([".", "!", "?"])
    shared = [[sentence(r.randint(3, 30)) for _ in range(r.randint(1, 6))] for _ in range(8)] + [[sentence(55)]]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts += r.choice(shared) if r.random() < 0.4 else [sentence(r.randint(1, 12))]
        texts.append("".join(p + r.choice([" ", "\n", " \n\n", "\t"]) for p in parts))
    texts += [None, "", "\n", "One.", 'He said "no." Then "yes!" ' * 30, "word " * 50_000, texts[5], (texts[6] or "").upper()]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, hash int, row int").repartition(3)
    got = {x.doc_id: (x.text, x.removed) for x in S.remove_repeats(docs).collect()}
    want = brute(rows)
    for i, _ in rows:
        assert got[i] == want[i], i
    assert sum(bool(g) for _, g in want.values()) > 20


def test_long_passages_do_not_repeat(spark):
    r = random.Random(9)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)).capitalize() + "."
    docs = spark.createDataFrame([(i, f"Start {i} here.\n{passage}\nEnd {i} there.") for i in range(50)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in S.remove_repeats(docs).collect()}
    assert [i for i, t in got.items() if passage in t] == [0]
    assert all(f"Start {i} here." in t and f"End {i} there." in t for i, t in got.items())


def test_edge_rows(spark):
    text = "This is one long enough sentence of quite some words. And this is another one that makes twenty words in all."
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (5, None)], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_removed, x.text) for x in S.remove_repeats(docs).collect())
    assert got == sorted([("2", 0, text), ("4", 2, ""), ("4", 2, ""), ("5", 0, ""), ("None", 2, "")])
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_passages_of_short_lines(spark):
    lines = "".join(f"{a}{b} dish{a}\n" for a in "abcdef" for b in "vwxyz")
    docs = spark.createDataFrame([(i, f"Menu of house {i} today.\n{lines}Closed on day {i}.") for i in range(4)] + [(9, "x!! y!! z!! " * 54)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in S.remove_repeats(docs).collect()}
    assert lines in got[0] and all(got[i] == f"Menu of house {i} today.\nClosed on day {i}." for i in range(1, 4))
    assert got[9].split() == ["x!!", "y!!", "z!!"]


def test_short_sentences_beside_long_ones(spark):
    long = " ".join(f"word{i}" for i in range(24)) + "."
    tails = ["One two three. Four five six. Seven eight nine. Ten. Eleven. Twelve.", "Ay. Be. Ce. De. Ef."]
    texts = [f"Start {i} here.\n{tails[1]} {long} {tails[0]}\nEnd {i} there." for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in S.remove_repeats(docs).collect()}
    assert got[0].text == texts[0] and [got[i].text for i in (1, 2)] == [f"Start {i} here.\nEnd {i} there." for i in (1, 2)]
