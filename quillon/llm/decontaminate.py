"""Benchmark decontamination by template windows; DataFrame functions only.

Texts become token sequences: numbers, letter runs. Canonical templates replace numbers, units
after a number, and names with typed placeholders and lower-case the rest, so that a re-parameterised
question keeps its template. What a name is cannot be told for sure at the start of a sentence, so
there are three readings: no word is a name, capitalised words inside a sentence are, or all words
with a capital are. Every window of eight template tokens with at least four literal ones is hashed
and joined with the windows of the benchmark; items of fewer tokens are one window, their whole.
Matches that lie on one diagonal (the same shift between document and item) make a copy if their
slots are consistent: each value of the item stands for one value of the document. Two values of an
item may have become one. Consistency is asked of the first reading, the first two, and all three;
what any of these leaves counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _lineage

WINDOW = 8
LITERALS = 4
#: A document holds an item from so many windows on (13 tokens in a row), or half of the item's.
WINDOWS, SHARE = 6, 0.5
#: At most so many windows of the benchmark are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "mg", "g", "kg", "lb", "lbs", "oz", "gram", "grams", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "ms", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "kmh", "mph", "v", "w", "kw", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb",
)
# A capitalised word inside a sentence keeps the space before it as a mark.
_TOKEN = r"(?<=[\p{Ll}\p{M},;])[\x20](?=\p{Lu}[\p{Ll}\p{M}])[\p{L}\p{M}]+|[\p{L}\p{M}]+|[0-9]+(?:[.,:][0-9]+)*"
# Placeholders sort before every literal token.
NUM, UNIT, NAME = "#num", "#unit", "#name"


def templates(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with low (lower-case tokens), tpl (template tokens) and reading; a row for each reading that differs."""
    rows = rows.withColumn("raw", F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TOKEN), F.lit(0)))
    rows = rows.withColumn("low", F.transform("raw", lambda x: F.lower(F.ltrim(x))))

    def one(x: F.Column, i: F.Column) -> F.Column:
        after = (i > 0) & (F.get("low", i - 1) < ":") & x.isin(*UNITS)
        return F.when(x < ":", F.lit(NUM)).when(after, F.lit(UNIT)).otherwise(x)

    rows = rows.withColumn("plain", F.transform("low", one))

    def named(is_name) -> F.Column:
        return F.zip_with("raw", "plain", lambda r, t: F.when((t > "9") & is_name(r, t), F.lit(NAME)).otherwise(t))

    def inside(r: F.Column, t: F.Column) -> F.Column:
        return r.startswith(" ")

    def capital(r: F.Column, t: F.Column) -> F.Column:
        return r != t

    readings = F.filter(F.array(F.col("plain"), named(inside), named(capital)), lambda x, i: (i == 0) | F.array_contains(x, F.lit(NAME)))
    return rows.select("*", F.posexplode(readings).alias("reading", "tpl")).drop("raw", "plain")


def windows(rows: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """hash, at and slots (lower-case values, null without a placeholder) of every window of a row's template.

    Of the readings with names only windows with a name are given; the first reading has the others.
    """
    # No lambda from here on: rows are made and hashed inside one generated loop, and arrays are not copied.
    value = F.zip_with("low", "tpl", lambda r, t: F.when(t < "0", r))
    rows = rows.filter(F.size("tpl") >= min(widths)).select(*keep, "reading", "tpl", value.alias("value"))
    rows = rows.select(*keep, "reading", "value", "tpl", F.explode(F.sequence(F.lit(0), F.size("tpl") - min(widths))).alias("at"))

    def window(width: int) -> tuple[F.Column, F.Column, F.Column]:
        at = [F.get("tpl", F.col("at") + k) for k in range(width)]
        n_slots = sum((F.when(t < "0", 1).otherwise(0) for t in at[1:]), F.when(at[0] < "0", 1).otherwise(0))
        name = at[0] == NAME
        for t in at[1:]:
            name = name | (t == NAME)
        good = (n_slots <= width - LITERALS) & ((F.col("reading") == 0) | name)
        if width > min(widths):
            good = good & at[-1].isNotNull()
        return good, F.xxhash64(*at), F.when(n_slots > 0, F.slice("value", F.col("at") + 1, width))

    if len(widths) == 1:
        good, hashed, slots = window(widths[0])
        return rows.filter(good).select(*keep, "reading", hashed.alias("hash"), "at", slots.alias("slots"))
    every = [F.when(good, F.struct(hashed.alias("hash"), slots.alias("slots"))) for good, hashed, slots in map(window, widths)]
    rows = rows.select(*keep, "reading", "at", F.explode(F.array(*every)).alias("w")).filter("w is not null")
    return rows.select(*keep, "reading", "w.hash", "at", "w.slots")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, row, item_id, n_windows, coverage of every document that holds an item of the benchmark.

    n_windows are the item's windows found on consistent diagonals, coverage their share of all; row
    is xxhash64 of the text, so that rows with one id, or none, can be told apart. Of items with
    one template and the same slot values the smallest id is named. Null or empty texts hold and give
    nothing. Items of four to seven tokens, four of them literal at least, are found whole; those of
    fewer literal tokens are common speech and give nothing. Repeated rows give one row. An item whose
    windows have too few literal tokens is found by the windows that have enough.
    """
    items = templates(benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")), "text")
    items = items.groupBy("tpl", "low").agg(F.min("item_id").alias("item_id"), F.min("reading").alias("reading"))
    items = items.groupBy("item_id", "tpl").agg(F.min("low").alias("low"), F.min("reading").alias("reading"))
    items = _lineage.cut(items)
    short = items.select(F.size("tpl").alias("n")).filter(F.col("n").between(LITERALS, WINDOW - 1)).distinct()
    widths = [*sorted(x["n"] for x in short.collect()), WINDOW]  # five widths at most
    asked = windows(items.filter(F.size("tpl") >= WINDOW), ["item_id"], [WINDOW])
    for n in widths[:-1]:
        asked = asked.unionByName(windows(items.filter(F.size("tpl") == n), ["item_id"], [n]))
    asked = asked.groupBy("item_id", "hash", F.col("at").alias("item_at")).agg(F.min("slots").alias("item_slots"))
    asked = _lineage.cut(asked)
    n_asked = asked.count()
    side = asked if n_asked > broadcast_windows else F.broadcast(asked)
    size = asked.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_item"))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    seen = windows(templates(rows, "text").drop("text"), ["doc_id", "row"], widths)
    hits = seen.join(side, "hash").select("doc_id", "row", "reading", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["slots"].isNotNull()).alias("pairs"))
    levels = range(3)
    sets = []
    for k in levels:
        upto = F.col("reading") <= k
        sets.append(F.collect_set(F.when(upto, F.col("item_at"))).alias(f"found{k}"))
        sets.append(F.array_distinct(F.flatten(F.collect_set(F.when(upto, F.col("pairs"))))).alias(f"pairs{k}"))
    along = hits.groupBy("doc_id", "row", "item_id", "shift").agg(*sets)

    def consistent(k: int) -> F.Column:
        return F.size(F.array_distinct(F.transform(f"pairs{k}", lambda p: p["item_slots"]))) == F.size(f"pairs{k}")

    found = F.flatten(F.array(*(F.when(consistent(k), F.col(f"found{k}")).otherwise(F.array().cast("array<int>")) for k in levels)))
    whole = along.select("doc_id", "row", "item_id", found.alias("found")).groupBy("doc_id", "row", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("found")))).cast("bigint").alias("n_windows"))
    whole = whole.join(size, "item_id").filter("n_windows > 0")
    return whole.filter(F.col("n_windows") >= F.least(F.lit(float(WINDOWS)), F.ceil(F.col("n_item") * SHARE))).select("doc_id", "row", "item_id", "n_windows", (F.col("n_windows") / F.col("n_item")).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, all columns kept."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leak_id"), F.col("row").alias("_leak_row")).distinct()
    return docs.join(bad, docs[id_col].cast("bigint").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(docs[text_col]) == F.col("_leak_row")), "left_anti")
