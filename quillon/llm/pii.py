"""Personal data and the terms that reveal it; DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers, found by patterns
and checked (parts, digits, Luhn). Added to them are secrets: values with digits of 16 characters
and more after a word like "token" and an equals sign or colon.

On top comes information-theoretic sanitisation. Protected entities are the kinds themselves and
every normalised value. The words within CONTEXT code points of an entity are its terms, and how
much of the entity's information a term discloses is estimated over the whole corpus:

    disclosure(e, t) = log2(P(e|t) / P(e)) / log2(1 / P(e)),
    P(e|t) = (c n(e,t) / n(t) + PRIOR P(e)) / (c + PRIOR),    P(e) = n(e) / N,

with N documents, n(e) that hold the entity, n(t) that hold the term anywhere, n(e,t) that hold the
term near the entity, and c distinct contexts that hold both: the estimate is shrunk to P(e) by the
evidence there is, so that copies of a document are no evidence and a word seen once tells nothing.
Terms of SUPPORT contexts that reach DISCLOSURE are spans of kind "term", wherever they stand in a
document that holds the entity. A word that the pattern of secrets itself asks for is no term: it
stands beside each of them by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _lineage

# The patterns of the base kinds. Possessive repeats and the look-behind (or the end of the match
# before) change no match: they only keep long runs from being tried at every place.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TRIGGER = r"token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key"
_SECRET_NAME = rf"(?i:{_TRIGGER})[\x22']?[\x20\t]{{0,2}}[:=]"
SECRET = rf"(?<={_SECRET_NAME}{{1,2}}[\x20\t]{{0,2}}[\x22']?)(?=[A-Za-z+/_=-]{{0,64}}[0-9])[A-Za-z0-9+/_=-]{{16,}}+"
#: All kinds that are protected, and what the method adds to the base.
PROTECTED = (*KINDS, "secret")
TERM = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}_'-]++"
#: Code points looked at on either side of a value.
CONTEXT = 60
#: Share of an entity's information from which a term discloses it, the least distinct contexts, and the weight of P(e).
DISCLOSURE, SUPPORT, PRIOR = 0.8, 2, 3.0
#: A text is cut into parts of about so many code points, at white space, to look for terms in it.
PART = 4_000
#: At most so many terms are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
_SPANS, _PLACES = "array<struct<s:int,e:int,m:string>>", "array<struct<s:int,e:int>>"


def _valid(kind: str, m: F.Column) -> F.Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(digits)

        def add(total: F.Column, i: F.Column) -> F.Column:
            d = F.substring(digits, n - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0
        return F.when(n.between(13, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _placed(text: F.Column, pattern: str, valid) -> F.Column:
    """Array of (s, e, m): code-point spans of the matches of a pattern that are valid, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(a: F.Column, x: F.Column) -> F.Column:
        # Only valid matches are put into the list, which is copied each time: long runs of numbers that are nothing cost a sum each.
        start = a["at"] + x["g"]
        end = start + F.length(x["m"])
        more = F.concat(a["spans"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))))
        return F.struct(end.alias("at"), F.when(valid(x["m"]), more).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate(steps, begin, step, lambda a: a["spans"])
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPANS))


def _with_spans(rows: DataFrame) -> DataFrame:
    """The rows (text not null) with an array of (s, e, m) for each protected kind."""
    text = F.col("text")
    hint = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": text.contains("+"),
        "secret": (text.contains("=") | text.contains(":")) & text.rlike(_SECRET_NAME),
    }
    patterns = KINDS | {"secret": SECRET}
    return rows.withColumns({k: F.when(hint[k], _placed(text, p, lambda m, k=k: _valid(k, m))).otherwise(F.array().cast(_SPANS)) for k, p in patterns.items()})


def _contexts(held: DataFrame) -> DataFrame:
    """doc_id, row, kind, value, context, words around every span of the rows of `held` (doc_id, row, text, spans)."""
    rows = held.select("doc_id", "row", "text", F.explode("spans").alias("x"))
    # A word cut by the far end of a side is left out.
    lo = F.greatest(F.col("x.s") - CONTEXT, F.lit(0))
    left = F.substring("text", lo + 1, F.col("x.s") - lo)
    right = F.substring("text", F.col("x.e") + 1, F.lit(CONTEXT))
    near = F.when(lo > 0, F.regexp_replace(left, r"^[\p{L}\p{M}\p{N}_'-]+", "")).otherwise(left)
    after = F.when(F.length("text") > F.col("x.e") + CONTEXT, F.regexp_replace(right, r"[\p{L}\p{M}\p{N}_'-]+$", "")).otherwise(right)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat(near, F.lit(" "), after)), F.lit(TERM), F.lit(0)))
    words = F.filter(words, lambda w: ~w.rlike(f"^(?:{_TRIGGER})$"))
    return rows.select("doc_id", "row", "x.kind", F.lower("x.m").alias("value"), F.xxhash64(left, right).alias("context"), words.alias("words"))


def disclosing_terms(docs: DataFrame, contexts: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """entity, term, disclosure of the terms that reveal an entity (kind, or kind:value), counted over all documents."""
    flat = contexts.select("doc_id", "row", "context", "words", F.explode(F.array("kind", F.concat_ws(":", "kind", "value"))).alias("entity"))
    terms = flat.select("entity", "doc_id", "row", "context", F.explode("words").alias("term"))
    # Each count is of distinct rows, which are dealt by all they are; a term's own group then gets one partial count a task.
    seen = terms.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("c")).filter(F.col("c") >= support)
    near = terms.select("entity", "term", "doc_id", "row").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    both = seen.join(near, ["entity", "term"])
    n_docs = docs.count()
    n_entity = flat.select("entity", "doc_id", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    before = F.least(F.col("n_entity") / n_docs, F.lit(1.0))

    def reached(share: F.Column) -> F.Column:
        given = (F.col("c") * F.least(share, F.lit(1.0)) + PRIOR * before) / (F.col("c") + PRIOR)
        return F.when(before < 1, F.log2(given / before) / F.log2(1 / before)).otherwise(0.0)

    # A term is in as many documents at least as it is near the entity in; what cannot reach the threshold needs no count.
    pairs = _lineage.table(both.join(n_entity, "entity").filter(reached(F.lit(1.0)) >= disclosure))
    asked = _lineage.cut(pairs.select("term").distinct())
    every = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    if asked.count() <= BROADCAST_TERMS:
        held = every.join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("n_term"))
    else:  # counted first, so that a common word is a count a task and not a row a document
        held = every.groupBy("term").agg(F.count("*").alias("n_term")).join(asked, "term", "left_semi")
    both = pairs.join(held, "term").withColumn("disclosure", reached(F.col("n_both") / F.col("n_term")))
    return both.filter(F.col("disclosure") >= disclosure).select("entity", "term", "disclosure")


def _parts(text: F.Column) -> F.Column:
    """Array of (at, part): a text in parts of about PART code points that end at white space, and where each starts."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}(?=\s|$)|.{{1,{PART}}}"), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,part:string>>").alias("parts"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["parts"], F.array(F.struct(a["at"].alias("at"), p.alias("part")))).alias("parts"))
    return F.aggregate(cut, begin, step, lambda a: a["parts"])


def term_spans(rows: DataFrame) -> DataFrame:
    """doc_id, row, term: the spans of disclosing terms in documents that hold what they reveal, for those that have any."""

    def named(kind: str) -> F.Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))

    every = F.flatten(F.array(*map(named, PROTECTED)))
    held = _lineage.table(_with_spans(rows).filter(sum((F.size(k) for k in PROTECTED), F.lit(0)) > 0).select("doc_id", "row", "text", every.alias("spans")))
    found = _lineage.cut(disclosing_terms(rows, _lineage.table(_contexts(held))).select("entity", "term"))
    entities = F.array_union(F.transform("spans", lambda x: x["kind"]), F.transform("spans", lambda x: F.concat_ws(":", x["kind"], F.lower(x["m"]))))
    parts = held.select("doc_id", "row", "spans", entities.alias("entities"), F.explode(_parts(F.col("text"))).alias("p"))
    placed = F.transform(_placed(F.col("p.part"), TERM, lambda m: F.lit(True)), lambda x: F.struct((x["s"] + F.col("p.at")).alias("s"), (x["e"] + F.col("p.at")).alias("e"), x["m"].alias("m")))
    words = parts.select("doc_id", "row", "spans", "entities", F.explode(placed).alias("w"))
    words = words.withColumn("term", F.lower("w.m")).join(found, "term").filter(F.array_contains("entities", F.col("entity")))
    words = words.filter(~F.exists("spans", lambda x: (x["s"] < F.col("w.e")) & (F.col("w.s") < x["e"])))
    return words.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("w.s", "w.e"))).alias("term"))  # at most the words of one document


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """user (a struct of all columns), text (null as empty), and the spans of every kind, term last."""
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("user"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = term_spans(plain.select("doc_id", "row", "text"))
    joined = _with_spans(plain).alias("r").join(terms.alias("t"), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.row") == F.col("t.row")), "left")
    return joined.select("user", "text", *PROTECTED, F.coalesce("term", F.array().cast(_PLACES)).alias("term"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and email, ip, card, phone, secret, term: arrays of spans (s, e: code points, end exclusive).

    Columns of these names are replaced. Null and empty texts have no spans. Repeated rows, and rows
    with a null id, are told apart by their text and each get their spans. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in (*PROTECTED, "term")]
    return _found(docs, id_col, text_col).select(*(F.col("user").getField(c).alias(c) for c in own), *PROTECTED, "term")


def listed(kinds: list[str]) -> F.Column:
    """kind:start:end of the spans, by kind as listed, then start, joined by commas."""

    def one(kind: str) -> F.Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))

    return F.array_join(F.flatten(F.array(*map(one, kinds))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term of every row."""
    found = find(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    more = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("secret", "term")]
    return found.select("doc_id", *counts, F.sha2(listed(list(KINDS)), 256).alias("base_sha256"), listed([*PROTECTED, "term"]).alias("spans"), *more)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the same columns, every span of the text replaced by its kind in brackets; a null text stays null.

    Spans that overlap are replaced as one, by the kind of the one that starts first (then by kind
    as listed). No other column changes, whatever its name.
    """
    found = _found(docs, id_col, text_col)
    kinds = [*PROTECTED, "term"]

    def one(n: int, kind: str) -> F.Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k")))

    spans = F.array_sort(F.flatten(F.array(*(one(n, k) for n, k in enumerate(kinds)))))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("t"))

    def step(a: F.Column, x: F.Column) -> F.Column:
        more = F.concat(a["t"], F.array(F.substring(text, a["p"] + 1, x["s"] - a["p"]), x["k"]))
        return F.struct(F.greatest(a["p"], x["e"]).alias("p"), F.when(x["s"] >= a["p"], more).otherwise(a["t"]).alias("t"))

    masked = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["t"], ""), F.substring(text, a["p"] + 1, F.length(text))))
    old = F.col("user").getField(text_col)
    any_span = sum((F.size(k) for k in kinds), F.lit(0)) > 0
    clean = F.when(any_span & old.isNotNull(), masked).otherwise(old)
    return found.select(*((clean if c == text_col else F.col("user").getField(c)).alias(c) for c in docs.columns))
