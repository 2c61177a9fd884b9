import re

import corpus_pipeline as P
import numpy as np
import test_jaccard_join
import test_packing
import test_pii

from quillon.llm import _lineage, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]

    kept = _lineage.table(steps["quality"](spark, docs, SF))
    assert kept.columns == columns
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    score = model.forward(*quality.encode([(r.text or "").encode() for r in rows]))[0]
    sure = np.abs(score - quality.THRESHOLD) > 1e-3
    ids = {r.doc_id for r in kept.collect()}
    assert all((r.doc_id in ids) == (s >= quality.THRESHOLD) for r, s, ok in zip(rows, score, sure) if ok)
    assert 0 < len(ids) < len(rows)

    single = steps["near_duplicates"](spark, kept, SF)
    assert single.columns == columns
    groups = test_jaccard_join.brute([(r.doc_id, r.text) for r in kept.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted({d for d, (_, c) in groups.items() if d == c})

    clean = steps["decontamination"](spark, single, SF)
    assert clean.columns == columns
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    for r in single.collect():
        assert not (r.doc_id in left and any(i in r.text.lower() for i in items))
        if r.doc_id not in left:
            assert any(" ".join(i.split()[:14]) in " ".join(r.text.lower().split()) for i in items)

    private = steps["personal_data"](spark, clean, SF)
    assert private.columns == columns
    after = {r.doc_id: r for r in private.collect()}
    for r in clean.collect():
        want, at = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b in test_pii.brute(r.text)):
            if a >= at:
                want += r.text[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        want += r.text[at:]
        got = re.sub(r"\[TERM\]", "", after[r.doc_id].text)
        assert got == want or "[TERM]" in after[r.doc_id].text
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)

    texts = [r.text for r in private.orderBy("doc_id").collect()]
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test_packing.check(steps["packing"](spark, numbered, SF).collect(), texts)


def test_run_is_the_stages_in_turn(spark):
    got = P.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = _lineage.table(stage(spark, docs, SF))
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_edge_rows(spark):
    text = "Some words that stand in a text of a fair length for a test."
    docs = spark.createDataFrame([(None, text, "en", "s", 5, None), (None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, text, None, "s", 1, 1), (2, text, None, "s", 1, 1), (3, text, "en", "s", 1, 1), (4, "mail a@b.cd", "en", "s", 1, 1)], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    once = P.one_of_each_group(spark, docs, SF)
    assert once.columns == docs.columns and sorted(str(r.doc_id) for r in once.collect()) == ["1", "2", "4", "None", "None"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).columns == docs.columns
    assert P.packed(spark, docs.limit(0), SF).count() == 0
    assert {r.text for r in P.without_personal_data(spark, docs, SF).collect()} == {text, None, "", "mail [EMAIL]"}
