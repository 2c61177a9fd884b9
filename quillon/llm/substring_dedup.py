"""Repeated passages by sliding sentence spans.

A text is cut into sentences, at line ends and after closing marks before white space. Runs of
consecutive sentences are hashed (the words, A-Z lower-cased): a sentence of 25 words or more, two
sentences with 20 words at least, three with 12, and any number from four on with 20. As every
sentence counted has a word, runs of more than 20 sentences hold no more than those of 20 do, so no
number of sentences is left out. Runs are joined globally by their hash; the first place of a hash,
by document and position, stays, and the sentences that any later place covers are removed.

A run whose two parts, without its last and without its first sentence, are runs too is not hashed:
where it repeats, both parts repeat and cover it. That leaves a few runs a sentence. Only DataFrame
functions are used. Hashes are counted with partial aggregation before the shuffle, and only hashes
seen twice are joined back. Frequent ones, as of a passage that a third of all documents share, are
broadcast, so that their places stay where they are; the others meet by a shuffle. A stretch that is
cut inside sentences is found by the whole sentences in it only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _components, _lineage

#: Least words of a run of four sentences and more.
WORDS = 20
#: (sentences, least words) of the runs; from WORDS sentences on, longer runs add nothing.
SPANS = ((1, 25), (2, 20), (3, 12), *((k, WORDS) for k in range(4, WORDS + 1)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends after closing marks before white space, or at a line end; white space belongs to what it follows.
_END = r"(?<=[.!?][\x22')\]]?)(?=[\x20\t])|(?<=\n)"


def sentences(text: F.Column) -> F.Column:
    """The sentences of a text, which joined give the text again; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _END, -1), lambda s: s != "")


def _normal(sentence: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def _reach(step: int, i: F.Column) -> F.Column:
    """Sentences of the shortest run of WORDS words from sentence i on (step 1) or up to it (step -1); 0 if fewer than five, or if there is none."""
    words = [F.coalesce(F.get("w", i + step * j), F.lit(0)) for j in range(4)]
    # Words times 32 and sentences, in one number.
    grown = F.aggregate(F.array(*map(F.lit, range(WORDS))), F.lit(0), lambda a, j: F.when(a >= 32 * WORDS, a).otherwise(a + 32 * F.coalesce(F.get("w", i + step * j), F.lit(0)) + 1))
    return F.when(sum(words[1:], words[0]) >= WORDS, 0).otherwise(F.when(grown >= 32 * WORDS, grown % 32).otherwise(0))


def places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hash, doc_id, row, at, n of the runs of sentences that cover all others; blank sentences belong to no run."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.transform(sentences(F.col(text_col)), _normal).alias("s"))
    # Positions of sentences with words; blank ones lie between them unseen.
    full = F.filter(F.transform("s", lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("w"))), lambda x: x["w"] > 0)
    rows = rows.select("doc_id", "row", full.alias("s")).filter(F.size("s") >= min(k for k, _ in SPANS))
    rows = rows.select("doc_id", "row", F.transform("s", lambda x: x["h"]).alias("h"), F.transform("s", lambda x: x["i"]).alias("i"), F.transform("s", lambda x: x["w"]).alias("w"))
    rows = rows.select("doc_id", "row", "h", "i", "w", F.transform("w", lambda x, i: _reach(1, i)).alias("on"), F.transform("w", lambda x, i: _reach(-1, i)).alias("back"))
    rows = rows.select("doc_id", "row", "h", "i", "w", "on", "back", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("p"))
    p, none = F.col("p"), F.lit(0)
    on, back = F.get("on", p), F.get("back", p)
    # Runs of one to four sentences here, each with the words of its parts; then those of five and more.
    w = [F.get("w", p + j) for j in range(4)]
    least = dict(SPANS)
    runs = [F.when(w[0] >= least[1], F.struct(p.alias("p"), F.lit(1).alias("k")))]
    for k in range(2, 5):
        every = sum(w[1:k], w[0])
        parts = (every - w[k - 1] >= least[k - 1]) & (every - w[0] >= least[k - 1])
        runs.append(F.when((every >= least[k]) & ~parts, F.struct(p.alias("p"), F.lit(k).alias("k"))))
    runs.append(F.when(on > none, F.struct(p.alias("p"), on.alias("k"))))
    # Up to p, unless it is the shortest from its start as well.
    runs.append(F.when((back > none) & (F.get("on", p - back + 1) != back), F.struct((p - back + 1).alias("p"), back.alias("k"))))
    # No lambda after the first explode: rows are made and hashed inside one generated loop.
    rows = rows.select("doc_id", "row", "h", "i", F.explode(F.array(*runs)).alias("run")).filter("run is not null")
    first, last = F.get("i", F.col("run.p")), F.get("i", F.col("run.p") + F.col("run.k") - 1)
    return rows.select(F.xxhash64(F.slice("h", F.col("run.p") + 1, F.col("run.k"))).alias("hash"), "doc_id", "row", first.alias("at"), (last - first + 1).alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed, removed, text of every row: the text without repeated passages.

    `removed` lists the numbers of the removed sentences from 0; a text whose sentences all go is
    empty. The first place of a run is that of the smallest doc_id (rows of one id: of the smaller
    text hash), then the first in the text. Rows with a null id come after all others and after each
    other by text hash. Exact repeats of a whole row, id included, are one document and stay alike.
    Null and empty texts have no sentences and stay empty. Other columns are not read.
    """
    seen = _lineage.table(places(docs, id_col, text_col))
    counts = _lineage.table(seen.groupBy("hash").count().filter("count > 1"))
    again = _components.looked_up(seen, "hash", counts.withColumn("times", F.col("count")), "times", "count").filter("times is not null")
    again = _lineage.table(again.withColumn("last", F.col("doc_id").isNull()))
    place = F.struct("last", "doc_id", "row", "at")
    first = _lineage.table(again.groupBy("hash").agg(F.min(place).alias("first"), F.first("times").alias("times")))
    later = _components.looked_up(again.drop("times"), "hash", first, "first", "times").filter(~F.col("first").eqNullSafe(place))
    cut = later.select("doc_id", "row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("i")).distinct()
    cut = cut.groupBy("doc_id", "row").agg(F.collect_set("i").alias("removed"))  # at most the sentences of one document
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    marked = rows.alias("r").join(cut.alias("c"), F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.row") == F.col("c.row")), "left")
    marked = marked.select("r.doc_id", "text", F.coalesce(F.array_sort("removed"), F.array().cast("array<int>")).alias("removed"))
    marked = marked.withColumn("s", sentences(F.col("text")))
    s = F.col("s")
    stay = F.array_except(F.sequence(F.lit(0), F.size(s) - 1), "removed")
    kept = F.when(F.size("removed") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(s, i)), ""))
    return marked.select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.size("removed").cast("bigint").alias("n_removed"), "removed", kept.alias("text"))
