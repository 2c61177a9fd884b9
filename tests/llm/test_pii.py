import hashlib
import math
import random
import re
import time

from quillon.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def card(r):
    head = "".join(r.choice("0123456789") for _ in range(r.randint(11, 19)))
    return next(head + d for d in "0123456789" if luhn(head + d))


def make(r):
    bits = ["a.b@c.de", "x@y", "A_b%c@d-e.f.g", "a@b.c_d@e.f@g.h", "1.2.3.4", "255.255.255.255", "1.2.3.256", "0001.02.3.4", "1.2.3.4.5.6.7.8", "1.2.3", "+1 (017) 555-7713", "+49 30 1234567", "+12", "++1234567890", "word", "été", "🙂", "12-34", card(r), " ".join(re.findall(".{1,4}", card(r))), card(r)[:-1] + "0", "+1" + card(r), "\n", ".", "-", "@", ""]
    return r.choice(["", " ", ", "]).join(r.choice(bits) for _ in range(r.randint(0, 25)))


def test_base_spans_as_python(spark):
    r = random.Random(3)
    texts = [make(r) for _ in range(600)] + [None, "", "9" * 60_000, "a" * 60_000, "1 " * 30_000, "x@" + "y." * 20_000 + "z", card(r) + " word " * 9_000 + card(r)]
    docs = spark.createDataFrame([(i, t, 1, "e") for i, t in enumerate(texts)], "doc_id long, text string, n_email int, email string").repartition(4)
    rows = {x.doc_id: x for x in pii.digest(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (t or "")[:200]
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(k == x for k, _, _ in want) for x in PATTERNS)
        assert ",".join(s for s in rows[i].spans.split(",") if not s.startswith(("term", "secret"))) == listed


SECRET = re.compile(r"(?i:(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \t]{0,2}[:=]{1,2}[ \t]{0,2}[\"']?)((?=[A-Za-z+/_=-]{0,64}[0-9])[A-Za-z0-9+/_=-]{16,})")
WORD = re.compile(r"[^\W\d_][\w'-]+")
TRIGGER = re.compile(r"token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key")


def brute_terms(rows):
    """The term spans of (doc_id, text) rows by plain counting."""
    held, near, contexts = {}, {}, {}
    spans = {}
    for d, t in rows:
        own = brute(t) + [("secret", m.start(1), m.end(1)) for m in SECRET.finditer(t)]
        spans[d] = own
        for kind, s, e in own:
            lo = max(0, s - 60)
            left, right = t[lo:s], t[e : e + 60]
            words = re.sub(r"^[\w'-]+", "", left) if lo else left
            words += " " + (re.sub(r"[\w'-]+$", "", right) if len(t) > e + 60 else right)
            for entity in (kind, f"{kind}:{t[s:e].lower()}"):
                held.setdefault(entity, set()).add(d)
                for w in {x.lower() for x in WORD.findall(words) if not TRIGGER.fullmatch(x.lower())}:
                    near.setdefault((entity, w), set()).add(d)
                    contexts.setdefault((entity, w), set()).add((left, right))
    holds = {d: {x.lower() for x in WORD.findall(t)} for d, t in rows}
    found = set()
    for (entity, w), docs in near.items():
        c, p = len(contexts[entity, w]), len(held[entity]) / len(rows)
        given = (c * len(docs) / sum(w in h for h in holds.values()) + 3 * p) / (c + 3)
        if c >= 2 and p < 1 and math.log2(given / p) / math.log2(1 / p) >= 0.8:
            found.add((entity, w))
    out = {}
    for d, t in rows:
        entities = {k for k, _, _ in spans[d]} | {f"{k}:{t[s:e].lower()}" for k, s, e in spans[d]}
        out[d] = sorted({m.span() for m in WORD.finditer(t) if any((x, m[0].lower()) in found for x in entities) and not any(s < m.end() and m.start() < e for _, s, e in spans[d])})
    return out


def test_terms_as_by_plain_counting(spark):
    r = random.Random(8)
    common, rare = [f"w{c}ord" for c in "abcdefghijklmnop"], [f"rare{c}" for c in "abcdefgh"]
    values = ["a.b@c.de", "x@mail.org", "12.13.14.15", "+49 30 1234567", 'token = "0123abcdef0123abcdef"', "api-key: zzzz1111zzzz1111"]
    rows = []
    for i in range(220):
        words = [r.choice(common) for _ in range(r.randint(1, 60))]
        if r.random() < 0.3:
            n = r.randrange(len(values))
            words[r.randrange(len(words))] = values[n] + " " + (rare[n] if r.random() < 0.9 else r.choice(rare))
            words.append(r.choice([rare[n], "Rare" + rare[n][4:].upper(), "end"]))
        elif r.random() < 0.1:
            words.append(r.choice(rare))
        rows.append((i, r.choice([" ", ", ", "\n"]).join(words)))
    rows += [(300 + i, rows[i][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_terms(rows)
    got = {x.doc_id: [(y.s, y.e) for y in x.term] for x in pii.find(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 20


def test_terms_that_reveal_a_value(spark):
    texts = [f"note {'abcdefgh'[i]} from Zorblax at zz@corp.org number {'ijklmnop'[i]}, and far from there, after a good many other words of no weight, {'Zorblax' if i else 'nobody'} again" for i in range(6)]
    texts += ["note from someone at home, number of days"] * 40 + ["mail other@corp.org now"] * 5 + ['the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is set']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x for x in pii.find(docs).collect()}
    for i in range(6):
        spans = [texts[i][s.s : s.e] for s in rows[i].term]
        assert spans.count("Zorblax") == (2 if i else 1) and not set(spans) & {"note", "from", "number", "at"}
    assert all(not rows[i].term for i in range(6, len(texts)))
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert clean[0].startswith("note a from [TERM] at [EMAIL] number i") and clean[10] == texts[10] and clean[47] == "mail [EMAIL] now" and clean[51] == 'the token = "[SECRET]" is set'


def test_terms_of_long_texts(spark, monkeypatch):
    """Terms are found where they stand, however a text is cut into parts; the time of a text grows with its length."""
    monkeypatch.setattr(pii, "PART", 50)
    filler = " ".join(f"{'abcdefghij'[i % 10]}x{'klmnopqrst'[i % 7]}y" for i in range(400))
    texts = [f"Zorblax zz@corp.org {'abcdef'[i]} {filler} \U0001f600 Zorblax\n{'w' * 130} zorblax" for i in range(6)] + ["plain words only"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.find(docs).collect():
        if x.doc_id < 6:
            t = texts[x.doc_id]
            assert [(m.start(), m.end()) for m in re.finditer("(?i)zorblax", t)] == [(y.s, y.e) for y in x.term if t[y.s : y.e].lower() == "zorblax"]
    monkeypatch.setattr(pii, "PART", 4000)
    long = "Zorblax zz@corp.org " + " ".join(f"word{i % 977}" for i in range(80_000)) + " Zorblax"
    docs = spark.createDataFrame([(i, long if i == 0 else texts[i]) for i in range(6)] + [(10 + i, "plain words") for i in range(60)], "doc_id long, text string")
    began = time.perf_counter()
    rows = {x.doc_id: x for x in pii.find(docs).collect()}
    assert [long[y.s : y.e] for y in rows[0].term].count("Zorblax") == 2 and time.perf_counter() - began < 60


def test_planted_names_are_found_and_little_else(spark):
    """Names that stand beside one person's values, in texts of common words: found with a precision and recall above 0.9."""
    r = random.Random(5)
    common = [f"{a}{b}en" for a in "bcdfghkl" for b in "aeiou"]
    people = [(f"{a}{b}rowski", f"{a}{b}@mail.org".lower()) for a in "BDGKLMNP" for b in "aeio"]
    rows, planted = [], {}
    for i in range(600):
        words = [r.choice(common) for _ in range(r.randint(20, 80))]
        if i % 4 == 0:
            name, address = people[(i // 4) % len(people)]
            at = r.randrange(len(words))
            words[at:at] = [name, r.choice(common), address]
            words.insert(r.randrange(at + 1), name)
            planted[i] = name.lower()
        rows.append((i, " ".join(words)))
    found = [(x.doc_id, rows[x.doc_id][1][y.s : y.e].lower()) for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for y in x.term]
    right = sum(planted.get(d) == w for d, w in found)
    assert right / len(found) > 0.9 and right / (2 * len(planted)) > 0.9


def test_columns_with_names_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "a@b.cd x", "mine", 7, "r", 5, "t", "s")], "doc_id long, text string, email string, _id int, _row string, row int, term string, spans string")
    assert [tuple(x) for x in pii.sanitise(docs).collect()] == [(1, "[EMAIL] x", "mine", 7, "r", 5, "t", "s")]
    assert pii.find(docs).columns == ["doc_id", "text", "_id", "_row", "row", "spans", "email", "ip", "card", "phone", "secret", "term"]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (None, None), (1, "a@b.cd"), (1, "a@b.cd"), (1, "")], "doc_id long, text string")
    assert sorted((str(x.doc_id), x.spans) for x in pii.digest(docs).collect()) == [("1", ""), ("1", "email:0:6"), ("1", "email:0:6"), ("None", ""), ("None", "email:0:6")]
    assert pii.digest(docs.limit(0)).count() == 0
    assert pii.sanitise(docs).columns == docs.columns
