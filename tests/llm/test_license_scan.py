import random
import re

from quillon.llm import license_scan as L


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), low


def pairs_of(text):
    """Neighbouring words of one sentence, in order."""
    marked = re.sub(r"[.!?][ \t\n\x0b\f\r]+([A-Z])", " \ue000 \\1", text or "")
    ws = words(marked)[0]
    return [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def brute(text):
    ws, low = words(text)
    places = [(i, label) for p, label in L.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    found, best, pairs = set(), 0.0, pairs_of(text)
    for label, source in L.templates():
        t = {p for p in pairs_of(source) if "\ue000" not in p}
        must = {p for p in t if any(w in L.DISTINGUISHING or any(c.isdigit() for c in w) for w in p.split())}
        step = 24 if len(words(source)[0]) + source.count(". ") <= 24 else 256
        for at in range(0, max(1, len(pairs)), step):
            block = set(pairs[at : at + 2 * step])
            n = len(block & t)
            if 100 * n >= 80 * len(t) and (n >= 7 or n == len(t)) and must <= block:
                found.add(label)
                best = max(best, n / len(t))
    base = sorted({x for _, x in places})
    starts = [i for i, _ in places]
    return (len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(found | set(base))), 1.0 if places else best)


def test_relatives_are_told_apart(spark):
    probes = [
        ("This work is licensed under the terms of the GNU General Public License.", "gpl"),
        ("You can redistribute it under the terms of the GNU Lesser General Public License as published.", "gpl,lgpl"),  # the base phrase says gpl
        ("Covered by the GNU Affero General Public License, see below.", "agpl,gpl"),
        ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("All of it: CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),  # the base phrase says cc-by
        ("Text and images CC BY-ND 3.0, no more", "cc-by,cc-by-nd"),
        ("Not licensed under the Apache License. Version 2.0 of our tool comes later.", ""),
        ("Licensed under the Apache License, Version 3.0", ""),
        ("We licensed 4 songs; under oath he said cc me, by 0 or more.", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(probes)], "doc_id long, text string")
    for x in L.scan(docs).collect():
        assert x.labels == probes[x.doc_id][1], probes[x.doc_id]
        assert brute(probes[x.doc_id][0])[5] == x.labels


def wrapped(text, r):
    """A notice as a comment, cut into short lines, after other words."""
    ws = text.split()
    lines, at = [], 0
    while at < len(ws):
        n = r.randint(3, 9)
        lines.append(r.choice(["# ", " * ", "// ", ""]) + " ".join(ws[at : at + n]))
        at += n
    return "word " * r.randint(0, 60) + "\n".join(lines)


def test_wrapped_notices_are_found(spark):
    r = random.Random(2)
    texts = [wrapped(t, r) for _, t in L.templates()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in L.scan(docs).collect():
        assert L.templates()[x.doc_id][0] in x.labels.split(","), texts[x.doc_id]
    assert not set(L.scan(spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0")], "doc_id long, text string")).first().labels.split(",")) & {"mit", "bsd"}


def test_same_as_brute_force(spark):
    r = random.Random(1)
    bits = [" ".join(t.split()) for _, t in L.templates()] + [p for p, _ in L.PHRASES] + ["CC BY", "Cc-By", "General\nPublic  License.", "général public license", "cc", "by", "All rights", "reserved.", "word", "the", "under", "licensed", "İcc by", "K", ". ", "\n", "; "]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(r.randint(0, 8)):
            ws = r.choice(bits).split(" ")
            if len(ws) > 3 and r.random() < 0.5:
                ws = [w for w in ws if r.random() < 0.85]
            parts.append(" ".join(ws))
        texts.append(r.choice([" ", ". ", "\n", ", "]).join(parts))
    texts += [wrapped(t, r) for _, t in L.templates() for _ in range(3)]
    texts += [None, "", "!!", "cc by " * 5_000, "x" * 100_000]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {x.doc_id: tuple(x)[1:] for x in L.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i][:6] == brute(t)[:6] and abs(got[i][6] - brute(t)[6]) < 1e-12, t


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "All rights reserved."), (2, "All rights reserved."), (2, "All rights reserved."), (2, None)], "doc_id long, text string")
    assert sorted((str(x.doc_id), x.n_base, x.labels) for x in L.scan(docs).collect()) == [("2", 0, ""), ("2", 1, "reserved"), ("2", 1, "reserved"), ("None", 1, "reserved")]
    assert L.scan(docs.limit(0)).count() == 0
