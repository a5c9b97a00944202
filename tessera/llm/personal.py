"""Personal data: base patterns, then information-theoretic sanitisation of what reveals them. DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. Each value is an entity to
protect. A term t (a word of four letters or more outside the addresses) reveals an entity e as far as the corpus shows
it: over all documents, PMI(e, t) = log2(N * (df(e, t) - DISCOUNT) / (df(e) * df(t))) against the entity's own
information IC(e) = log2(N / df(e)). A term is disclosed if PMI(e, t) >= beta * IC(e) for any entity, and each of its
occurrences in any document gets a span of kind `term`. df counts documents, df(e, t) those that have both. The absolute
discount is the smoothing for rare entities: what was seen together once proves little, in a small corpus nothing.
The condition is the same as (df(e, t) - DISCOUNT) / df(t) >= (df(e) / N)^(1 - beta), so terms that are too frequent for
an entity are dropped before pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, named_back, set_aside

# Possessive forms of the base patterns: they match the same text and never backtrack over long runs. A match
# can only begin where a run begins or where the match before it ended (\G).
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "term")
#: Cheap tests that a text must pass before a pattern is tried.
NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), "phone": lambda t: t.contains("+")}
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
WORD = r"\p{L}{4,}+"
DISCOUNT = 0.75


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body reads it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, keep=None, block: int = 256) -> Column:
    """array<struct<start,end,value>> of the matches that keep(value) holds for, in code points from 0; text may not be null.

    Places are summed within blocks of matches, then over the blocks, so that texts with very many cost no square.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    none = F.array().cast(kind)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))).cast(kind)
        kept = x["m"].isNotNull() if keep is None else x["m"].isNotNull() & keep(x["m"])
        return F.struct(end.alias("at"), F.when(kept, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    def add(s: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda m: F.struct((m["start"] + s["at"]).alias("start"), (m["end"] + s["at"]).alias("end"), m["value"].alias("value")))
        return F.struct((s["at"] + b["at"]).alias("at"), F.when(F.size(b["out"]) > 0, F.concat(s["out"], F.array(moved))).otherwise(s["out"]).alias("out"))

    def summed(z: Column) -> Column:
        state = lambda out: F.struct(F.lit(0).alias("at"), out.alias("out"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / block)), lambda b: F.aggregate(F.slice(z, (b * block + 1).cast("int"), block), state(none), step))
        return F.aggregate(blocks, state(F.array().cast(f"array<{kind}>")), add, lambda s: F.flatten(s["out"]))

    return let(pairs, summed)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(bare, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(value) < 12, F.lit(False)).otherwise(let(digits_of(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))))
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    def found(rank: int, kind: str) -> Column:
        passed = matches(text, PATTERNS[kind], lambda v: valid(kind, v))
        shaped = F.transform(passed, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(NEEDS[kind](text), shaped).otherwise(F.array().cast(SPAN))

    return F.sort_array(F.concat(*[found(rank, kind) for rank, kind in enumerate(KINDS[:4])]))


def terms_of(text: Column) -> Column:
    """The distinct words of four letters or more, lower-cased, that lie in no e-mail address."""
    bare = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.filter(F.split(F.lower(bare), r"[^\p{L}]++"), lambda w: F.length(w) >= 4))


def disclosed(docs: DataFrame, base: DataFrame, total: int, beta: float, broadcast_rows: int) -> DataFrame:
    """(term) of all terms that reveal an entity. docs: key, text; base: key, _s of the same rows."""

    def small(df: DataFrame, label: str) -> DataFrame:
        df = cut(df, label, total)
        return F.broadcast(df) if df.count() <= broadcast_rows else df  # else both sides are shuffled

    name = F.transform("_s", lambda s: F.concat(s["rank"].cast("string"), F.lit(":"), F.lower(s["value"])))
    held = base.where(F.size("_s") > 0).select("key", F.explode(F.array_distinct(name)).alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("w"))
    held = cut(held, "entities", total)
    df_entity = held.groupBy("entity").agg(F.sum("w").alias("df_entity"))
    share = F.pow(F.col("df_entity") / float(total), F.lit(1.0 - beta))
    held = held.select("key", "entity").join(df_entity.where(F.col("df_entity") < total), "entity").select("key", "entity", share.alias("least"), ((F.col("df_entity") - DISCOUNT) / share).alias("most"))
    held = cut(held, "bounds", total)
    widest = held.agg(F.max("most")).first()[0]
    words = docs.select("key", F.explode(terms_of(F.col("text"))).alias("term"))
    df_term = words.groupBy("term").agg(F.count("*").alias("df_term")).where(F.col("df_term") <= (widest or 0.0))
    near = words.join(small(held.groupBy("key").agg(F.max("most").alias("widest")), "keys"), "key").groupBy("key", "term", "widest").agg(F.count("*").alias("w"))
    near = near.join(df_term, "term").where("df_term <= widest").select("key", "term", "w", "df_term")
    both = near.join(held, (near["key"] == held["key"]) & (near["df_term"] <= held["most"])).groupBy("entity", "term", "df_term", "least").agg(F.sum("w").alias("both"))
    return cut(both.where((F.col("both") - DISCOUNT) / F.col("df_term") >= F.col("least")).select("term").distinct(), "terms", total)


def scan_personal(docs: DataFrame, beta: float = 0.9, text_out: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_spans and spans (kind:start:end, comma-joined) of each row.

    With text_out all columns of docs come first, and text is sanitised: each span gives way to its kind's
    mark, overlaps once. A null text counts as empty (and stays null in text_out). Rows are kept one for one,
    repeated ones too, and each counts as a document. An empty table gives no rows. Columns of docs that have
    the name of an added one come back with _in after it.
    """
    given, docs = docs if text_out else docs.select("doc_id"), set_aside(docs)
    kept = docs.columns if text_out else ["doc_id"]
    held = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    base = cut(held.select(*kept, F.md5(F.col("_t").cast("binary")).alias("key"), base_spans(F.col("_t")).alias("_s")), "personal")
    texts = held.select(F.md5(F.col("_t").cast("binary")).alias("key"), F.col("_t").alias("text"))
    found = disclosed(texts, base, max(base.count(), 1), beta, broadcast_rows)
    terms = F.broadcast(found) if found.count() <= broadcast_rows else found
    with_terms = cut(texts.select("key", F.explode(terms_of(F.col("text"))).alias("term")).join(terms, "term", "left_semi").select("key").distinct(), "keys", base.count())
    few = F.broadcast(with_terms) if with_terms.count() <= broadcast_rows else with_terms
    places = texts.join(few, "key", "left_semi").dropDuplicates(["key"]).select("key", F.explode(matches(F.col("text"), WORD)).alias("m"))
    places = places.select("key", F.lower("m.value").alias("term"), F.col("m.start").alias("start"), F.col("m.end").alias("end")).join(terms, "term", "left_semi")
    term = F.struct("start", F.lit(4).alias("rank"), "end", F.lit(None).cast("string").alias("value"))
    places = places.groupBy("key").agg(F.collect_list(term).cast(SPAN).alias("_terms"))
    out = base.join(places, "key", "left").withColumn("_terms", F.coalesce("_terms", F.array().cast(SPAN)))
    out = out.withColumn("_all", F.when(F.size("_terms") == 0, F.col("_s")).otherwise(F.sort_array(F.concat(F.col("_s"), outside(F.col("_terms"), F.col("_s"))))))

    def named(spans: str) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("_all", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)]
    if text_out:
        out = out.withColumn("text", sanitised(F.col("text"), F.col("_all")))
    out = out.select(*kept, *counts, named("_s").alias("base_spans"), named("_all").alias("spans"))
    return named_back(out, given)


def outside(terms: Column, spans: Column) -> Column:
    """The terms that overlap none of the base spans."""
    return F.filter(terms, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def sanitised(text: Column, spans: Column) -> Column:
    """text with marks for spans (by start); of overlapping ones the first has the mark. Read once, whatever the number of spans."""
    marks, kind, block = F.array(*map(F.lit, MARKS)), "array<struct<from:int,start:int,mark:string>>", 256

    def step(s: Column, x: Column) -> Column:
        one = F.array(F.struct(s["at"].alias("from"), x["start"].alias("start"), F.get(marks, x["rank"]).alias("mark"))).cast(kind)
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    def cuts(blocks: Column, tops: Column) -> Column:
        before = lambda i: F.coalesce(F.array_max(F.slice(tops, F.lit(1), i)), F.lit(0))
        state = lambda i: F.struct(before(i).alias("at"), F.array().cast(kind).alias("out"))
        return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, state(i), step, lambda s: s["out"])))

    def joined(chars: Column) -> Column:
        part = lambda low, high: F.array_join(F.slice(chars, low + 1, high - low), "")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / block)), lambda b: F.slice(spans, (b * block + 1).cast("int"), block))
        top = lambda b: F.array_max(F.transform(b, lambda x: x["end"]))
        marked = let(blocks, lambda b: let(F.transform(b, top), lambda t: F.array_join(F.transform(cuts(b, t), lambda x: F.concat(part(x["from"], x["start"]), x["mark"])), "")))
        return F.concat(marked, let(top(spans), lambda end: part(end, F.greatest(F.size(chars), end))))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.filter(F.split(text, ""), lambda c: c != ""), joined))
