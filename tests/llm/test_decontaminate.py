import re

from quillon.llm import decontaminate as D

ITEM = "It took Anna 12 km to walk from there with 3 dogs and 12 cats over the long hill at noon."
OTHER = "Completely different words stand in this second question about rivers and some old bridges near town."


def found(docs, items, spark, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in D.leaks(d, i, **more).collect())


def test_copies_and_new_parameters(spark):
    docs = [
        (1, "Before it. " + ITEM + " After it."),
        (2, ITEM.replace("Anna", "Maria").replace("12", "45").replace("3 dogs", "7 dogs")),
        (3, ITEM.replace("12 km", "45 km").replace("12 cats", "46 cats")),  # one value of the item stands for two
        (4, ITEM.lower()),
        (5, ITEM.replace("12", "3")),  # two values of the item become one, a valid change of parameters
        (6, "It took Anna 12 km to walk from there, nothing more."),
        (7, OTHER.upper()),
        (8, " ".join(OTHER.split()[:13])),
        (9, " ".join(OTHER.split()[:9])),
        (10, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
    ]
    items = [(9, ITEM), (10, ITEM), (20, OTHER), (30, "1 2 3 4 5 6 7 8 9 10 11 12"), (40, None), (50, ""), (60, "too short")]
    want = [(1, 9), (2, 9), (4, 9), (5, 9), (7, 20), (8, 20)]
    assert found(docs, items, spark) == want
    assert found(docs, items, spark, broadcast_windows=0) == want


def test_names_at_the_start_of_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"
    sam = item.replace("Tom", "Sam").replace("5", "7").replace("3", "4")
    docs = [
        (1, sam),
        (2, "Read this. " + sam + " Then go on."),
        (3, sam.replace("Sam buys", "Eve buys").replace("does Sam", "does Ann")),  # one name of the item stands for three
        (4, "The weather was fine. Nobody knew why. The old town lay there, and Sam had no apples now."),
    ]
    assert found(docs, [(1, item)], spark) == [(1, 1), (2, 1)]
    # A reading that is not consistent takes nothing from the readings before it.
    long = "However, the small boat sailed past seven quiet islands before the storm. However, nobody on board had seen the light of the tower"
    assert found([(1, long.replace("However, nobody", "But, nobody"))], [(1, long)], spark) == [(1, 1)]


def test_short_items_are_found_whole(spark):
    items = [(1, "Who wrote this old song?"), (2, "What is it?"), (3, "1 2 3 4 5"), (4, "Where did Anna buy 7 green lamps?"), (5, ITEM)]
    docs = [
        (1, "who wrote this OLD song"),
        (2, "They asked who wrote this old song, and what is it?"),
        (3, "who wrote this new song"),
        (4, "1 2 3 4 5"),
        (5, "Say: Where did Maria buy 9 green lamps?"),
        (6, "who wrote this old"),
        (7, ITEM),
    ]
    assert found(docs, items, spark) == [(1, 1), (2, 1), (5, 4), (7, 5)]
    assert found(docs, items[:1], spark) == [(1, 1), (2, 1)]


def test_very_long_texts(spark):
    filler = "some plain words of no item at all 12 and Then more. " * 5_000
    assert found([(1, filler + ITEM + filler), (2, filler)], [(7, ITEM)], spark) == [(1, 7)]


def test_windows_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*", t.lower())
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    bench = {r.item_id: grams(words(r.text)) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, g in bench.items() if g and len(grams(words(r.text)) & g) >= min(6, len(g) / 2)}
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()} == want and want


def test_edge_rows(spark):
    docs = [(None, ITEM), (1, None), (1, ITEM), (1, ITEM), (1, "clean"), (2, "")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, hash int, at int")
    i = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in D.leaks(d, i).collect()) == [("1", 7), ("None", 7)]
    kept = D.decontaminate(d, i)
    assert kept.columns == d.columns and sorted(str(r.text) for r in kept.collect()) == ["", "None", "clean"]
    assert D.leaks(d.limit(0), i).count() == 0 and D.leaks(d, i.limit(0)).count() == 0
    assert D.decontaminate(d, i.limit(0)).count() == 6
